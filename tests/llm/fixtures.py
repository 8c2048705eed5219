"""A small table of hard rows, and the same rows as plain Python."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    own = random.Random(seed)
    return " ".join(own.choice(PROSE) + str(own.randrange(60)) for _ in range(n))


def rows() -> list[tuple]:
    passage = prose(1, 60)
    base = prose(2, 200)
    words = base.split()
    texts = [
        None,
        "",
        "   \n\t \x0b\x0c\r ",
        "one",
        "two words",
        "a b c d e a b c d e a b c d e f g h",
        "line one here\nline one here\n\n  \nother line\nline one here",
        prose(3, 30) + " " + passage + " " + prose(4, 20),
        prose(5, 25) + "\n" + passage + "\n" + prose(6, 35),
        base,
        base,
        base + "  ",
        " ".join(words[:100] + ["changed"] + words[101:]),
        " ".join(words[:50] + ["x"] + words[50:]),
        " ".join(words[:150]),
        prose(7, 5000) + passage,
        "This work is licensed under the GNU General Public License, version 3. MIT License; CC-BY 4.0, Apache-License",
        "MIT license mit LICENSE mit license",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files",
        "İstanbul ŒUVRE straße ΟΔΟΣ naïve é \U0001f600 12²½ <|endoftext|> 'll don't",
        "#### $$$$ %%%% && || <<>>  " * 10,
        "ab" * 450,
        "xyz " * 3,
        "　\x85wide\xa0blank",
    ]
    made = [(10 * i + 3, t, ["en", "de", None][i % 3], ["s0", None][i % 2], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return [*made, (1000, passage, "en", "s0", len(passage)), (1001, passage[:150], "en", "s0", 150), made[9], (None, "no id here at all", "en", "s0", None)]


def table(spark, extra: bool = True, some: list[tuple] | None = None):
    df = spark.createDataFrame(rows() if some is None else some, SCHEMA)
    if extra:  # names that operators use for their own columns
        for name in ("id", "slot", "shard", "kept", "n_words", "words", "key", "start", "_row", "next_text"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
