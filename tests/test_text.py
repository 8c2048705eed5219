import re

from pyspark.sql import functions as F

from lumenlog import queries
from lumenlog.functions import text

#: The reference's pattern (src/core/redaction.ts), written out.
URL_PASSWORD = re.compile(r"""(\b[a-z][a-z0-9+.-]{0,30}://[^\s:/@"']{1,256}:)[^\s/@"']{1,256}(?=@)""", re.I)


def test_passwords_in_urls_are_redacted(spark):
    lines = [
        "connect postgres://app:s3cret@db:5432/x failed",
        "two AMQP://u:p$1@h and redis+tls://me:pw:more@cache/0",
        "no password https://host:8080/path and mailto user@example.com, http://user@host",
        'quoted "ftp://a:b@c" end',
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, text string")
    found = [r[0] for r in rows.orderBy("id").select(text.redact(F.col("text"))).collect()]
    assert found == [URL_PASSWORD.sub(lambda m: m[1] + "[REDACTED]", x) for x in lines]
    assert found[0] == "connect postgres://app:[REDACTED]@db:5432/x failed" and found[2] == lines[2]


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return sum(digits[::2]) % 10 == 0 if len(digits) == 1 else (sum(digits[::2]) + sum(sum(divmod(2 * c, 10)) for c in digits[1::2])) % 10 == 0


def test_all_kinds_of_sensitive_values_are_counted(spark, tmp_path):
    texts = ["mail bob@corp.io now", "mail bob@example.com", "pay 4111 1111 1111 1111 ok", "pay 4111 1111 1111 1112 no", "amex 3782 822463 10005", "AKIA" + "A" * 16 + " and ann@corp.io", "nothing", None]
    rows = [(i, x, ["s0", "s1"][i % 2]) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, x, source in rows:
        card = re.search(r"[3-6]\d{3}(?: \d{4} \d{4} \d{4}| \d{6} \d{5})", x or "")
        email = re.search(r"\w+@[\w.]+", x or "")
        for kind, there in (("email", email and not email[0].endswith("example.com")), ("card", card and luhn(card[0].replace(" ", ""))), ("aws-key", "AKIA" in (x or ""))):
            if there:
                n, _ = want.get((source, kind), (0, 0))
                want[source, kind] = (n + 1, i)
    found = queries.QUERIES["g22_sensitive_kinds"](spark, str(tmp_path)).collect()
    assert {(r.source, r.kind): (r.documents, r.last_id) for r in found} == want
    assert want == {("s0", "email"): (1, 0), ("s0", "card"): (2, 4), ("s1", "email"): (1, 5), ("s1", "aws-key"): (1, 5)}


def test_queries_over_all_events_take_every_event(spark):
    tables = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{tables}/events.parquet").count()
    for name, column in (("e2_columns", "id"), ("c23_metric_points", "value"), ("h1_context_all", "anchor")):
        assert queries.QUERIES[name](spark, tables).select(column).distinct().count() == n


def test_redaction_fails_closed(spark):
    """Containers of any depth, brackets that don't match, JSON within quoted text, very long texts."""
    from lumenlog.functions import redaction

    r = "[REDACTED]"
    cases = {
        'password={"a":{"b":{"c":"deepsecret"}}} next': f"password={r} next",
        'secret: ["x",["y",["zz"]]], kind: 1': f"secret: {r}, kind: 1",
        'token={"a":["}",{"b":"]"}]} x': f"token={r} x",
        '{"msg":"{\\"password\\":\\"hunter2\\",\\"n\\":1}"}': '{"msg":"{\\"password\\":\\"' + r + '\\",\\"n\\":1}"}',
        'x "{\\"secret\\":\\"a\\\\\\"b\\"}" y': 'x "{\\"secret\\":\\"' + r + '\\"}" y',
        "password={never closed: 1\nmore": f"password={r}",
        'password=[1,{"a":2}': f"password={r}",
        "secret=" + "[" * 40 + "s" + "]" * 40 + " rest": f"secret={r}",
        "cookie={} token=[] a={b}": f"cookie={r} token={r} a={{b}}",
        '{"nested":' * 3000 + '{"password":"deep-secret"}' + "}" * 3000: '{"nested":' * 3000 + f'{{"password":"{r}"}}' + "}" * 3000,
        "password=" + '{"k":"' + "v" * 200_000 + '"}': f"password={r}",
        "token={" + "1," * 100_000 + "2} end": f"token={r} end",
        "a=" * 50_000 + " pwd=x": "a=" * 50_000 + f" pwd={r}",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", redaction.redact_text(F.col("t")).alias("r")).collect()
    assert {x.t: x.r for x in rows} == {**cases, None: None}
