"""Terminal output in whole and in chunks of any size."""

import random

import pytest

from lumenlog.sources import terminal

CASES = {
    "plain\nlines\r\n\nend": [(1, "plain"), (2, "lines"), (4, "end")],
    "10%\r50%\r100% \x1b[32mdone\x1b[0m  \nnext": [(1, "100% done"), (2, "next")],
    "\x1b]0;title\x07a\x1b]8;;http://x\x1b\\b\x1b]8;;\x1b\\\n": [(1, "ab")],
    "one \x1b[?1049hhidden\nstill\x1b[?1049l two\n": [(1, "one"), (2, " two")],
    "\x1b[?47hx\r\n\x1b[?47ly\x1b[?1047hz\x1b[?1047l!\n": [(2, "y!")],
    "a\x1b[?1049hb\rc\x1b[?1049ld\n": [(1, "d")],
    "cut \x1b[31\nafter \x1b]0;open\nlast\x1b": [(1, "cut"), (2, "after"), (3, "last")],
    "tab\tbell\x07 null\x00 \x1b(Bset \x1bMup\n": [(1, "tab\tbell null Bset up")],
    "gone\r\r\n  \n\x1b[2K\n": [],
    "": [],
}


@pytest.mark.parametrize("sizes", [[10_000], [1], [2, 5, 3]])
def test_lines(spark, sizes):
    own, rows, n = random.Random(1), [], 0
    for k, text in enumerate(CASES):
        at = 0
        while at < len(text) or not at:
            size = own.choice(sizes)
            rows.append((k if k else None, n, text[at : at + size] or None, "x"))
            at, n = at + size, n + 1
    chunks = spark.createDataFrame(rows, "session int, n int, text string, line string").repartition(3)
    found = {}
    for r in terminal.terminal_lines(chunks).collect():
        found.setdefault(r.session or 0, []).append((r.line, r.text))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in enumerate(CASES.values()) if v}
    assert terminal.terminal_lines(chunks.limit(0)).count() == 0
