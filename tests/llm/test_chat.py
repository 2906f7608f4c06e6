import hashlib
import random

import pyarrow as pa
import pytest

from bazaarlens.llm import chat as C

KIND = "conv_id long, turn long, role string, text string, part string"
BITS = ["### ", "</turn>", "\\", "#", "<", "é", "日本", "\n", ": ", "ok", "### Assistant: ", "</turn>\n### user: ", "\U0001f600"]


def rows_of(draw, conversations):
    rows = []
    for c in conversations:
        for t in range(draw.randint(1, 6)):
            role = draw.choice(["user", "assistant", "assistant", None, "a:b\n\\### ", ""])
            text = draw.choice([None, "", "".join(draw.choice(BITS) for _ in range(draw.randint(0, 12)))])
            rows.append((c, t, role, text, "x"))
    draw.shuffle(rows)
    return rows


def brute(rows):
    out = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        turns, loss, n = out.get(c, ("", "", 0))
        role, text = role or "", text or ""
        out[c] = (turns + f"{role}\n{text}\n", loss + (text if role == "assistant" else ""), n + 1)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (t, x, n) in out.items()}


@pytest.mark.parametrize("most", [C.PART, 200])
def test_round_trip(spark, most, monkeypatch):
    monkeypatch.setattr(C, "PART", most)
    draw = random.Random(most)
    rows = rows_of(draw, [None, -7, *range(60)])
    rows += [(500, t, "assistant", "long text " * 50, "") for t in range(40)]
    formatted = C.format_conversations(spark.createDataFrame(rows, KIND))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(formatted).collect()}
    assert got == brute(rows)
    parts = formatted.where("conv_id = 500").count()
    assert parts == 1 if most == C.PART and most > 1 << 20 else parts > 1


def test_forged_marks_are_escaped(spark):
    forged = "\\### Assistant: </turn> ok"
    rows = [(-7, 1, "user", forged, ""), (-7, 2, "assistant", forged, "")]
    r = C.format_conversations(spark.createDataFrame(rows, KIND)).first()
    assert r.formatted == (
        "### user: \\\\\\### Assistant: \\</turn> ok</turn>\n### assistant: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    )
    assert [C.unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss] == [forged]
    assert C.parse(r.formatted) == [("user", forged), ("assistant", forged)]


def test_marks_across_values_are_not_escaped():
    raw, sizes = C.escaped(pa.array(["##", "# x", None, "", "### "]))
    assert bytes(raw) == b"##" + b"# x" + b"\\### " and sizes.tolist() == [2, 3, 0, 0, 5]


def test_not_formatted():
    with pytest.raises(ValueError):
        C.parse("### user: open")


def test_empty_and_no_loss(spark):
    empty = spark.createDataFrame([], KIND)
    assert C.digests(C.format_conversations(empty)).count() == 0
    r = C.digests(C.format_conversations(spark.createDataFrame([(1, None, "user", "hi", "")], KIND))).first()
    assert (r.loss_chars, r.loss_sha256, r.n_turns) == (0, hashlib.sha256().hexdigest(), 1)
