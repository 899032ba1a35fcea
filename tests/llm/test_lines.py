"""Site-relative line dedup against plain counting."""

import random

from pairmatch.llm.lines import site_line_dedup


def brute(rows, ratio, pages):
    texts, holds = {}, {}
    for _, host, t in rows:
        texts.setdefault(host, set()).add(t)
    for host, own in texts.items():
        for t in own:
            for line in {x for x in (t or "").split("\n") if t is not None and x.strip(" ")}:
                holds[host, line] = holds.get((host, line), 0) + 1
    bad = {k for k, n in holds.items() if n >= pages and n > ratio * len(texts[k[0]])}
    out = []
    for d, host, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (host, x) not in bad]
        out.append((str(d), str(host), None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(spark, rows, ratio=0.2, pages=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, line string")
    got = site_line_dedup(df, max_ratio=ratio, min_pages=pages, carry=("doc_id", "line")).collect()
    assert sorted(((str(r.doc_id), str(r.source), r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(brute(rows, ratio, pages), key=str)
    assert all(r.line == "x" for r in got)


def test_random(spark):
    rng = random.Random(11)
    lines = ["a", "b ", " ", "", "Footer", "© x"] + [f"line {i}" for i in range(60)]
    rows = [(i, rng.choice(["s1", "s1", "s1", "s2", None]), "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))) for i in range(150)]
    check(spark, rows + rows[:20])


def test_edges(spark):
    rows = [(i, "s", f"menu\nbody {i}\nmenu") for i in range(5)] + [(9, "s", None), (10, "s", ""), (11, "s", "\n\n"), (None, None, "menu")]
    rows += [(20 + i, "copies", "same\nlines") for i in range(50)] + [(90, "copies", "other")]       # copies count as one page
    rows += [(99, "s", "long line " * 20000 + "\nmenu")]
    check(spark, rows)
    check(spark, [])
