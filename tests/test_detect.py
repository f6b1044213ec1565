"""Detectors on short texts, the cases that decide between a hit and a miss."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hushspan.functions.rules import GIVEN_NAMES, RULES, check
from hushspan.functions.spans import places, rules_spans
from hushspan.operators import detect, gate
from hushspan.operators.detect import name_spans
from hushspan.plans.pipeline import Pipeline
from hushspan.queries import ORACLES, QUERIES

NAMES = set(GIVEN_NAMES)


@pytest.fixture(scope="module")
def rule_hits(spark):
    cases = [
        ("SSN 123-45-6789.", "ssn"), ("a.b+c@mail.example.org", "email"), ("at 10.0.0.1 now", "ip"), ("mrn: A1234567", "mrn"), ("Acct# 12345678", "account"),
        ("eyJhbGci.eyJzdWIi.sig-1", "jwt"), ("Driver's License No: D1234567", "license"), ("aged; age 47", "age"), ("62 years old", "age"), ("Sex: F", "sex"),
        ("ethnicity: Hispanic", "race"), ("marital status: Widowed", "marital"), ("zip code 41011-1234", "zip"), ("Group No. 77X12", "group"), ("Accession # T-00123", "testid"),
        ("seen March 2019", "date"), ("see clinic.example.co.uk", "domain"), ("Member ID: W123456789", "beneficiary"), ("CPT 90837", "cpt"), ("F32.1", "icd10"), ("dx: F32", "icd10"),
        ("group therapy", ""), ("version 1.2.3", ""), ("file.txt", ""), ("member since", ""), ("90837", ""), ("B12", ""), ("may 2019", ""), ("", ""),
    ]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(cases)], "doc_id long, text string, kind string")
    return df.withColumn("found", F.transform(detect.regex_spans(F.col("text")), lambda s: s["type"])).collect()


def test_rules(rule_hits):
    for row in rule_hits:
        assert (row["kind"] in row["found"]) if row["kind"] else not row["found"], row


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([(1, "é😀 x@y.org, 10.0.0.1")], "doc_id long, text string")
    spans = df.select(detect.regex_spans(F.col("text")).alias("s")).first()["s"]
    for s in spans:
        assert "é😀 x@y.org, 10.0.0.1"[s["start"] : s["end"]] == s["value"]
    assert {s["type"] for s in spans} == {"email", "ip", "domain"}


def test_tables():
    found = detect.delimited('Patient ID,City,State,Dx\r\nA1,"Covington, KY",KY,F32.1\r\n\r\nB2, Paris ,TX,low mood since May\r\n')
    assert [(s["value"], s["type"], s["disposition"]) for s in found] == [("A1", "mrn", "redact"), ("Covington, KY", "address", "redact"), ("F32.1", "icd10", "flag"), ("B2", "mrn", "redact"), ("Paris", "address", "redact")]
    assert detect.delimited("Member ID,City,x\nM1,Paris\n") == [] == detect.delimited("MRN,x\nA1,2") == detect.delimited("Member ID, and more, here")
    assert [s["value"] for s in detect.delimited("mrn\ta\tb\nX9\t1\t2")] == ["X9"]


def test_json():
    value = lambda t: [(s["value"], s["type"]) for s in detect.json_fields(t)]
    assert value('{"patient_id": "A\\"1", "zip": 41011, "name": "x"}') == [('A\\"1', "mrn"), ("41011", "address")]
    assert value('{"mrn": ["1", ["x"], {"chart": "2"}, 3]}') == [("1", "mrn"), ("3", "mrn")]
    assert value('{"mrn": ["1", "2"') == [] == value('{"mrn": {}}') == value('mrn: "1"') == value('{"mrn": ""}')
    assert value('{"diagnosis": "sad today", "dx": "F32"}') == [("F32", "icd10")]


def test_names(spark):
    texts = ["JANICE and Table", "Alice Parkinson's disease is stable.", "Parkinson's disease", "Mx. Renner's disease", "Mx.\nRenner's disease", "Alice's disease", "Dr. Zed Quill came"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select(detect.common_name_spans(F.col("text")).alias("c"), detect.name_spans(F.col("text")).alias("n")).collect()
    assert [s["value"] for s in rows[0]["c"]] == ["JANICE"]
    assert [[s["value"] for s in r["n"]] for r in rows[1:]] == [["Alice Parkinson"], [], ["Renner"], ["Renner"], ["Alice"], ["Zed Quill"]]


def test_title_case():
    assert detect.title_cased("maria o'neil 3rd straße") == "Maria O'neil 3Rd Straße" or detect.title_cased("maria o'neil") == "Maria O'neil"
    assert len(detect.title_cased("ǆ ß ŉ x")) == len("ǆ ß ŉ x")


def test_merge_of_passes(spark):
    df = spark.sql("select array(named_struct('start', 0, 'end', 3), named_struct('start', 5, 'end', 8)) a, array(named_struct('start', 0, 'end', 8), named_struct('start', 9, 'end', 12), named_struct('start', 2, 'end', 6)) b")
    kept = df.select(detect.merged(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert sorted((s["start"], s["end"]) for s in kept) == [(0, 8), (9, 12)]


def test_user_rules(spark):
    rules = [{"name": "slow", "pattern": "(a|aa)+$"}, {"name": "bad", "pattern": "ZX("}, {"name": "off", "pattern": "b", "is_enabled": False}, {"name": "ok", "pattern": "ZX\\d+", "case_insensitive": True}]
    good, bad = detect.usable(rules)
    assert [r["name"] for r in good] == ["slow", "ok"] and bad == ["bad"]
    df = spark.createDataFrame([(1, "zx12 " + "a" * 60 + "!"), (2, "no"), (3, None)], "doc_id long, text string")
    rows = df.select("doc_id", detect.user_spans(F.col("text"), rules).alias("u")).orderBy("doc_id").collect()
    assert [s["value"] for s in rows[0]["u"]["spans"]] == ["zx12"] and rows[0]["u"]["timed_out"] == ["slow"]
    assert rows[1]["u"]["timed_out"] == [] == rows[2]["u"]["spans"]
    with pytest.raises(Exception, match="rules over their time: slow"):
        Pipeline(layers=["regex"], user_rules=rules).run(df).select("redacted_text").collect()
    null = Pipeline(layers=["regex"], user_rules=rules, on_error="null").run(df).orderBy("doc_id").collect()
    assert null[0]["redacted_text"] is None and "slow" in null[0]["error"] and null[1]["redacted_text"] == "no"


def test_check_of_patterns():
    assert check("a*") and check("(") and not check("a+")
    assert all(check(r.pattern.replace("(?i:MRN)", "MRN")) is None for r in RULES)


def test_gate():
    model = lambda value, kind="name", confidence=1.0, start=0: {"start": start, "end": start + len(value), "value": value, "type": kind, "confidence": confidence, "source": "foundationModel"}
    stands = lambda m, text, others=(): [s["value"] for s in gate.gated([m], list(others), text, NAMES)]
    assert stands(model("Zed", confidence=0.5), "Zed") == ["Zed"] and not stands(model("Zed", confidence=0.49), "Zed")
    assert not stands(model("hey my"), "hey my") and stands(model("patient Alice"), "patient Alice") == ["patient Alice"]
    over = [{"start": 0, "end": 4}]
    assert not stands(model("MMSE"), "MMSE") and stands(model("SMITH"), "SMITH", over) == ["SMITH"] and stands(model("ALICE"), "ALICE") == ["ALICE"]
    assert not stands(model("2026"), "2026") and stands(model("4471209"), "4471209") == ["4471209"]
    assert not stands(model("x", "other"), "x") and stands(model("x", "other"), "x", over) == ["x"]
    assert stands(model("Sarah Connor met us"), "Sarah Connor met us") == ["Sarah Connor"]
    assert stands(model("Anna van der Berg"), "Anna van der Berg") == ["Anna van der Berg"] and stands(model("田中 陽子"), "田中 陽子") == ["田中 陽子"]
    assert not stands(model("Rogerian therapy"), "Rogerian therapy") and stands(model("Rogerian therapy"), "Rogerian therapy", over) == ["Rogerian"]
    assert gate.anchored([{"type": "NAME", "value": "Bo", "confidence": 2.0}] * 3, "Bo Bo")[1]["start"] == 3
    assert gate.anchored([{"type": "NAME", "value": "no", "confidence": 1.0}], "Bo") == []


def test_no_detector_is_an_error():
    with pytest.raises(ValueError):
        Pipeline(layers=[])
    with pytest.raises(ValueError):
        Pipeline(layers=["none"])


def test_long_texts_of_a_rules_own_alphabet(spark):
    """Chains that Java would match by recursion, and very many matches in one text."""
    rule = {r.type: r for r in RULES}
    texts = [("a." * 500_000 + " x.com", [(1_000_001, "x.com")]), ("a." * 100_000 + "com.b x", [(0, "a." * 100_000 + "com")]), ("b.com_x www.foo.com.bar-baz.qux foo.com-x.bar", [(8, "www.foo.com"), (32, "foo.com")])]
    for text, want in texts:
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        got = df.select(rules_spans(F.col("text"), [rule["domain"]]).alias("s")).first()["s"]
        assert [(s["start"], s["value"]) for s in got] == want
    many = "10.0.0.1 " * 20_000
    began = time.time()
    got = spark.createDataFrame([(1, many)], "doc_id long, text string").select(rules_spans(F.col("text"), [rule["ip"]]).alias("s")).select(F.size("s").alias("n"), F.col("s")[19_999]["start"].alias("last")).first()
    assert (got["n"], got["last"]) == (20_000, 179_991) and time.time() - began < 60
    names = "Mr John " + "A-" * 8_000 + "A end"
    assert spark.createDataFrame([(1, names)], "doc_id long, text string").select(name_spans(F.col("text")).alias("s")).first()["s"][0]["start"] == 3


def test_domain_chain_equals_the_plain_pattern(spark):
    rng, rule = random.Random(5), {r.type: r for r in RULES}["domain"]
    bits = ["a", "b-c", "com", "org", ".", ".", "-", "_", " ", "é", "x" * 63, "y" * 64, "de", "9", "com-", ".co"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", F.transform(places(F.col("text"), rule.java, rule.flags + rule.inside), lambda m: m["value"]).alias("new"), F.regexp_extract_all("text", F.lit("(?U)" + rule.pattern), 0).alias("old")).collect()
    assert [r["doc_id"] for r in got if r["new"] != r["old"]] == []


def test_phone_query_equals_its_sql(spark, tmp_path):
    rng, bits = random.Random(7), ["743", "3824", "-", " ", "."] * 4 + ["+1", "(", ")", "20", "5", "a", "_", "é", "😀", "٣٣٣", "\n"]
    inside = ["38.253.197.126 4880761348116108", "é😀 204.213.132 4116106959541135\nÉ", "123-456-78901234-567-8901", "x123 456 7890", "+1 (743) 555-3824_"]
    texts = inside + ["call +1 (743) 555-3824.", "٣٣٣-٣٣٣-٣٣٣٣", "", None] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["phone_spans"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["phone_spans"]).fetchall())
    assert [r[:4] for r in got[:2]] == [(0, 7, 19, "197.126 4880"), (1, 7, 19, "213.132 4116")] and {r[0] for r in got} >= {2, 3, 4, 5} and not {r[0] for r in got} & {6, 7, 8}
    # the detectors' rule stays bounded
    kept = df.where("doc_id < 6").select("doc_id", F.transform(detect.data_spans(F.col("text")), lambda s: s["value"]).alias("v")).orderBy("doc_id").collect()
    assert [r["v"] for r in kept] == [[], [], [], [], [], ["+1 (743) 555-3824"]]


def test_columns_are_not_overwritten(spark):
    df = spark.createDataFrame([(1, "a@b.co", "mine")], "doc_id long, text string, error string")
    assert Pipeline().run(df).first()["error"] == "mine"
    with pytest.raises(ValueError):
        Pipeline().run(df.withColumnRenamed("error", "spans"))
    with pytest.raises(ValueError):
        Pipeline(user_rules=[{"name": "n", "pattern": "x"}]).run(df)
