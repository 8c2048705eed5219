"""Lines of text from what a terminal was sent: chunks with control sequences, redraws and a second screen.

Chunks may end anywhere, also within a sequence. Lines are put together first: a chunk's pieces between
line feeds get the number of the line feeds before them, a running sum over ranges of chunks. Whether a
line begins on the second screen is the last switch in any line before it, a running value too. What
remains is done within each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.scans import ranged, running
from lumenlog.scratch import Scratch

# Forms of control sequences, and those that switch to the second screen and back.
TITLES = r"\x1b\](?:[^\x07\x1b]|\x1b(?!\\))*+(?:\x07|\x1b\\|\z)"
SWITCH = r"\x1b\[\?(?:1049|1047|47)"
SEQUENCES = r"\x1b\[[\x20-\x3f]*+[\x40-\x7e]?|\x1b(?:[^\[]|\z)"
#: Marks of switches on and off within a line whose other control characters are gone.
ON, OFF = "\x01", "\x02"


def _marked(line: Column) -> Column:
    """The line with marks for switches, carriage returns and tabs, and no other control characters or sequences."""
    out = F.regexp_replace(line, r"[\x00-\x06\x08\x0b\x0c\x0e-\x1a\x1c-\x1f]", "")
    out = F.regexp_replace(out, TITLES, "")
    out = F.regexp_replace(F.regexp_replace(out, SWITCH + "h", ON), SWITCH + "l", OFF)
    return F.regexp_replace(F.regexp_replace(out, SEQUENCES, ""), r"\x07", "")


def terminal_lines(chunks: DataFrame, session: str = "session", order: str = "n", text: str = "text") -> DataFrame:
    """``session``, ``line`` (its number from 1) and ``text`` of every line that shows something.

    A line that is drawn anew after a carriage return has its last text; one directly before the line
    feed changes nothing. What is written to the second screen isn't told, nor are titles, colours and other
    sequences; one that isn't complete ends with its line. The rest after the last line feed is a line. Blanks at a
    line's end go, and lines without text. Null chunks are empty, a null session is one; lines are whole, however long.
    """
    scratch = Scratch(chunks.sparkSession, "terminal")
    own = chunks.select(F.col(session).alias("session"), F.col(order).alias("at"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("pieces"))
    fed = running(ranged(own, ["session"], ["at"], scratch), ["session"], ["at"], {"before": ("sum", (F.size("pieces") - 1).cast("bigint"))})
    pieces = fed.select("session", "at", F.coalesce("before", F.lit(0)).alias("before"), F.posexplode("pieces").alias("k", "piece"))
    listed = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = pieces.groupBy("session", (F.col("before") + F.col("k") + 1).alias("line")).agg(F.array_join(F.transform(listed, lambda p: p["piece"]), "").alias("raw"))
    marked = ranged(joined.select("session", "line", F.regexp_replace(_marked(F.col("raw")), r"\r\z", "").alias("marked")), ["session"], ["line"], scratch)
    last = lambda t: F.regexp_extract(t, rf"(?s)^.*([{ON}{OFF}])", 1)
    switched = last(F.col("marked"))
    known = running(marked, ["session"], ["line"], {"state": ("last", F.when(switched != "", switched))})
    shown = F.substring_index("marked", "\r", -1)  # after the last redraw
    drawn = known.withColumns({"shown": shown, "earlier": F.regexp_extract("marked", r"(?s)^(.*)\r", 1)})
    begins = F.coalesce(F.when(last(F.col("earlier")) != "", last(F.col("earlier"))), F.col("state"), F.lit(OFF))
    plain = F.regexp_replace(F.regexp_replace(F.concat(begins, "shown"), rf"{ON}[^{OFF}]*+", ""), OFF, "")
    return drawn.select(F.col("session").alias(session), "line", F.regexp_replace(plain, r"\s+$", "").alias("text")).where("text <> ''")
