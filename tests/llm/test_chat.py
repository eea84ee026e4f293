"""Chat examples against plain Python, escapes and edge cases."""

import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["\\### Assistant: </turn> ok", "<turn>", "<\\turn>", "\\", "\\\\<text>", "</turn>\n<turn>user<text>x</turn>\n", "", None, "a\nb", "<\\/turn>", "<"]


def escaped(text):
    return re.sub(r"<(/?turn>|text>)", r"<\\\1", text.replace("\\", "\\\\"))


def plain(rows):
    """(conv_id, text, start, chars) of each example."""
    talks, found = {}, []
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in talks.items():
        done = ""
        for i, (_, _, role, text) in enumerate(sorted(turns)):
            head = f"<turn>{escaped(role)}<text>"
            start, done = len(done) + len(head), done + head + escaped(text) + "</turn>\n"
            if role == "assistant" or i == len(turns) - 1:
                found.append((c, done, start if role == "assistant" else None, len(escaped(text)) if role == "assistant" else None))
    return found


def rows_of(n):
    roles = ["user", "assistant", "user", "system", None, "as<text>sistant"]
    return [(c, None if i == 0 and c % 2 else i, roles[(c + i) % 6], ODD[(c * 3 + i) % len(ODD)]) for c in range(n) for i in range(1 + c % 7)]


def check(spark, rows):
    made = chat.examples(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in ("conv_id", "text", "loss_start", "loss_chars")) for r in made.collect()), key=key) == sorted(plain(rows), key=key)
    talks = {}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert back.keys() == talks.keys()
    for c, turns in talks.items():
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in sorted(turns))
        loss = "".join(text for _, _, role, text in sorted(turns) if role == "assistant")
        r = back[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_and_what_is_read_back(spark):
    check(spark, rows_of(40))


def test_edge_cases(spark):
    empty = chat.examples(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and chat.read_back(empty).count() == 0
    check(spark, [(1, 0, "user", "ä\\" * 100_000), (1, 1, "assistant", "é<turn>" * 100_000)])
    check(spark, [(5, 1, "assistant", "same")] * 4 + [(None, 0, "user", "x"), (None, 1, "assistant", "y")])
    wide = spark.createDataFrame(rows_of(9), SCHEMA).selectExpr("*", "1 as example", "2 as turns", "3 as pieces")
    assert chat.examples(wide).count() == len(plain(rows_of(9)))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<>/turnex a\n", max_size=30), min_size=1, max_size=20))
def test_escapes_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("*", chat.unescape(F.col("e")).alias("back")).collect():
        assert r["back"] == r["t"] and not re.search(r"</?turn>|<text>", r["e"])
