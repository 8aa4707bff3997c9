import hashlib
import random
from collections import Counter

import pytest

from bowline.llm import linededup
from bowline.llm.queries import QUERIES
from bowline.llm.tables import ROW

BLANKS = " \t\r\x0b\x0c"


def brute(rows, ratio=linededup.RATIO, min_pages=linededup.MIN_PAGES):
    pages, n = Counter(), Counter()
    for _, t, _, host in rows:
        pages[host] += 1
        for line in {x.strip(BLANKS) for x in (t or "").split("\n")} - {""}:
            n[host, line] += 1
    bad = {k for k, v in n.items() if v >= min_pages and v > ratio * pages[k[0]]}
    out = []
    for i, t, _, host in rows:
        if t is None:
            out.append((i, 0, 0, None, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (host, x.strip(BLANKS)) not in bad]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), len(text), hashlib.sha256(text.encode()).hexdigest()))
    return out


def corpus():
    r = random.Random(2)
    rows = []
    for i in range(120):
        host = r.choice(["hot", "hot", "small", None])
        lines = ["unique %d %d" % (i, k) for k in range(r.randint(0, 5))]
        if r.random() < 0.3:
            lines.insert(r.randint(0, len(lines)), r.choice(["Footer of the site", " Footer of the site\t", "rare menu"]))
        rows.append((i, "\n".join(lines), "en", host))
    return rows + [(200, None, "en", "hot"), (201, "", "en", "hot"), (202, "\n\n \n", "en", "hot"), (203, "Footer of the site", "en", "hot"),
                   (204, "one\n" * 40_000, "en", "hot"), (None, "Footer of the site\nx", None, None), (0, rows[0][1], "en", rows[0][3]),
                   (205, "a\r\nFooter of the site\r\nb", "en", "hot")]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force(spark, table_dir, frame):
    rows = corpus()
    got = QUERIES["op9_line_dedup"](spark, table_dir(documents=frame(rows))).collect()
    assert order(got) == order(brute(rows))


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_both_joins_agree(spark, frame, limit):
    rows = corpus()
    got = linededup.drop_lines(frame(rows), ratio=0.02, broadcast_bytes=limit).selectExpr(
        f"{ROW}.doc_id", "n_lines", "n_dropped", "length(kept_text)", "sha2(kept_text, 256)").collect()
    assert order(got) == order(brute(rows, ratio=0.02))


def test_empty_table(spark, table_dir, frame):
    assert QUERIES["op9_line_dedup"](spark, table_dir(documents=frame([]))).count() == 0
