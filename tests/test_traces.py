import random
import subprocess
import sys
import time

from pyspark.sql import functions as F

from lumenlog.functions import redaction, text
from lumenlog.operators import traces
from lumenlog.scratch import Scratch

SPAN = "trace_id string, span_id string, parent_id string, name string, service string, start_ms double, end_ms double, status_code int"


def spans(spark, some):
    return spark.createDataFrame([("t", i, p, i, "s", float(a), float(b), 0) for i, p, a, b in some], SPAN)


def test_a_span_that_names_itself_is_a_root(spark):
    own = spans(spark, [("a", "a", 0, 10), ("b", "a", 1, 4)])
    assert sorted((r.span_id, r.depth, r.ordinal, r.offset_ms) for r in traces.waterfall(own).collect()) == [("a", 0, 1, 0.0), ("b", 1, 2, 1.0)]
    assert {r.span_id: r.self_ms for r in traces.self_times(own).collect()} == {"a": 7.0, "b": 3.0}
    assert traces.summaries(own).first().root_name == "a"


def test_deep_chains_cycles_and_empty_tables(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None, i, 500) for i in range(300)]
    own = spans(spark, [*chain, ("x", "y", 0, 1), ("y", "x", 0, 1), ("z", "gone", 2, 3)])
    found = {r.span_id: r.depth for r in traces.waterfall(own).collect()}
    assert found == {**{f"n{i:03d}": i for i in range(300)}, "z": 0}
    assert {r.span_id: r.step for r in traces.critical_paths(own).collect()} == {f"n{i:03d}": i for i in range(300)}
    assert traces.waterfall(spans(spark, [])).count() == traces.critical_paths(spans(spark, [])).count() == 0


def test_traces_walked_in_tasks_and_dealt_out_agree(spark):
    dice, some = random.Random(5), []
    for trace in ("a", "b", None, "d"):
        for i in range(60):
            parent = None if i == 0 or dice.random() < 0.1 else f"s{dice.randrange(i) if dice.random() < 0.5 else i - 1}"
            some.append((trace, f"s{i}", parent, float(dice.randrange(8)), float(dice.randrange(8)), dice.randrange(9)))
    some += [("d", "x", "y", -5.0, 1.0, 1), ("d", "y", "x", -6.0, 1.0, 1), ("d", "z", "x", 0.0, 1.0, 1), ("e", "q", "q", None, 1.0, 2), ("e", "w", "q", 3.0, 1.0, 1)]
    own = spark.createDataFrame(some, "trace_id string, span_id string, parent_id string, start_ms double, end_ms double, v bigint")
    walked, dealt, both = (sorted((str(r) for r in traces._toured(own, Scratch(spark, "tour"), ["v"], most).collect())) for most in (1000, 0, 60))
    assert walked == dealt == both and len(walked) == 242


def test_a_waterfall_does_not_gather_paths_in_the_driver(spark):
    """Ranges of paths were sampled into the driver, whose size grows with the depth of the traces."""
    chain = spark.range(2000).selectExpr("id div 500 AS trace_id", "CAST(id AS STRING) AS span_id", "CASE WHEN id % 500 > 0 THEN CAST(id - 1 AS STRING) END AS parent_id", "CAST(id % 500 AS DOUBLE) AS start_ms", "500.0D AS end_ms")
    found = traces.waterfall(chain)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "path" not in plan and "RepartitionByExpression [trace_id" in plan
    assert {(r.span_id, r.depth, r.ordinal) for r in found.collect()} == {(str(i), i % 500, i % 500 + 1) for i in range(2000)}


def test_natural_keys_of_long_numbers(spark):
    names = ["a9" + "0" * 20, "a1" + "0" * 25, "a007", "a7b", "A10", "a"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a", "a007", "a7b", "A10", "a9" + "0" * 20, "a1" + "0" * 25]


def test_redaction_by_key(spark):
    cases = {
        "password=hunter2 next": "password=[REDACTED] next",
        "token_count=5 max_tokens: 7 oldpwd=/home Pwd=x": "token_count=5 max_tokens: 7 oldpwd=/home Pwd=[REDACTED]",
        "'secret' : 'a b' \"api-key\":\"c\\\"d\"": "'secret' : '[REDACTED]' \"api-key\":\"[REDACTED]\"",
        "Authorization: Basic abc=, x": "Authorization: [REDACTED], x",
        "https://h/?access_token=abc&x": "https://h/?access_token=[REDACTED]",
        "nothing here: at all": "nothing here: at all",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", redaction.redact_text(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == {**cases, None: None}
    event = spark.createDataFrame([("m password=x", None, {"a.token": "1", "token": "1", "b": None, "Card": "9"})], "message string, raw string, fields map<string,string>")
    found = redaction.redact_event(event, configured=("c-a-r-d",)).first()
    assert (found.message, found.raw, found.fields) == ("m password=[REDACTED]", None, {"a.token": "[REDACTED]", "token": "[REDACTED]", "b": None, "Card": "[REDACTED]"})


def test_words_without_a_value_are_passed_over(spark):
    """A long word was searched for sensitive words, and each of those for its end, in every pass."""
    rows = spark.createDataFrame([("token" * 20_000,), ("api key: x",)], "t string").select(redaction.redact_text(F.col("t")).alias("r"))
    start = time.monotonic()
    assert [r.r for r in rows.collect()] == ["token" * 20_000, "api key: [REDACTED]"]
    assert time.monotonic() - start < 15


def test_sensitive_fields_are_found_once_a_map(spark):
    """They were found again for every field of the map."""
    shown = redaction.redact_fields(F.col("m"))._jc.toString()
    assert shown.count("map_entries") == 1 and shown.count("transform_values") == 1
    assert shown.index("map_entries") < shown.index("transform_values")  # an argument of the lambda, not within it


def test_the_core_works_without_the_subpackage():
    code = "import sys; sys.modules['tokenizers'] = None; sys.modules['lumenlog.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 70 and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
