"""Chat formatting: folding an event log against a plain fold, and the rendered text read back."""

import random

from pairmatch.llm.chat import fold_messages, format_log, read_back, turn_events

SCHEMA = "conv_id long, seq long, msg long, role string, kind string, text string, starts int"


def plain(events):
    """Apply the events of one conversation in order."""
    out = {}
    for _, msg, kind, text, role in sorted(events, key=lambda e: e[0]):
        if kind in ("edit", "regenerate"):
            for m in [m for m in out if m >= msg]:
                del out[m]
            out[msg] = (role, text if kind == "edit" else "")
        else:
            r, t = out.get(msg, (role, ""))
            out[msg] = (r, t + text)
    return [(m, *out[m]) for m in sorted(out)]


def test_fold_as_in_order(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(30):
        events, seq = [], 0
        for _ in range(rng.randint(1, 25)):
            seq += rng.randint(1, 3)
            msg = rng.randint(0, 4)
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            events.append((seq, msg, kind, "" if kind == "regenerate" else rng.choice(["a", "b ", "c\n"]), f"r{msg}"))
        want[conv] = plain(events)
        rows += [(conv, s, m, r, k, t, 0) for s, m, k, t, r in events]
    rng.shuffle(rows)
    got = {c: [] for c in want}
    for r in fold_messages(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.conv_id].append((r.msg, r.role, r.text))
    assert {c: sorted(v) for c, v in got.items()} == want


CONTROL = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi", "\\b\\l\\h\\", "", " ", "###", "a: b\n", "é日🙂" * 50]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROL)]
    rows += [(2, 0, "sys: <tem>\n#", "x"), (3, 0, None, None), (None, 1, "user", "no id"), (4, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    out = {r.conv_id: r for r in read_back(format_log(turn_events(df))).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t) for _, _, r, t in rows[:len(CONTROL)]]
    assert out[1].loss_text == "".join(CONTROL[1::2])
    assert [(t.role, t.text) for t in out[2].turns] == [("sys: <tem>\n#", "x")] and out[2].loss_text == ""
    assert [(t.role, t.text) for t in out[3].turns] == [("", "")]
    assert out[4].loss_text == "" and len(out[4].turns) == 1
    assert out[1].formatted.count("</turn>\n") == len(CONTROL)


def test_mask_covers_the_escaped_texts(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROL)],
                               "conv_id long, turn long, role string, text string")
    (r,) = format_log(turn_events(df)).collect()
    parts = [r.formatted[m.start:m.start + m.length] for m in r.mask]
    undo = lambda s: s.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\")
    assert [undo(p) for p in parts] == CONTROL[1::2]


def test_repeated_turns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    (r,) = read_back(format_log(turn_events(df))).collect()
    assert [t.text for t in r.turns] == ["a", "b", "b"]
    assert read_back(format_log(turn_events(df.limit(0)))).collect() == []
