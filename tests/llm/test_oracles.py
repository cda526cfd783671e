"""Queries of the subpackage that SQL can express, on the tables and on odd rows."""

import pytest

from oracle import same
from tidewave.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, FOLDER), registry.ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", ["op3_secret_scans", "op5_exact_dedup"])
def test_odd_documents_equal_sql(spark, odd, tmp_path, name):
    # where identifiers repeat, which of the equal rows is flagged is free, so they are left out for op5
    rows = odd.where("doc_id is not null and doc_id <> 6") if name == "op5_exact_dedup" else odd
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLE_SQL[name], str(tmp_path))


def test_secrets_equal_sql(spark, tmp_path):
    key = "AKIA" + "Z" * 16
    texts = ["token=token:abcdefgh", "password = 'abcdef' é secret:x", f"𝒳 {key} AKIAshort", "api_key:" + "f" * 30, "ghp_" + "a" * 36, "TOKEN==abcdef", "-----BEGIN RSA PRIVATE KEY-----", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(registry.QUERIES["op3_secret_scans"](spark, str(tmp_path)), registry.ORACLE_SQL["op3_secret_scans"], str(tmp_path))


def test_aliases_equal_sql(spark, tmp_path):
    rows = [
        (1, "http://a.org/es/1", '<link rel="canonical" href="http://Q.de/x#f">'), (2, "http://q.de/x", "<p>"), (3, "http://b.net/de/8", '<meta http-equiv=refresh content="0; url=/zz">'),
        (4, "http://b.net/zz", "x"), (5, "http://b.net/zz#k", "<LINK href='//q.de/x' rel=canonical>"), (6, None, None), (7, "nope", ""), (8, "http://q.de/only", None), (9, "http://c.net/de/1", "<link rel=canonical href=http://q.de/x>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    frame = registry.QUERIES["op1_url_filters"](spark, str(tmp_path))
    same(frame, registry.ORACLE_SQL["op1_url_filters"], str(tmp_path))
    verdict = {r["page_id"]: r["verdict"] for r in frame.collect()}
    assert verdict == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}


def test_odd_conversations_equal_sql(spark, tmp_path):
    turns = [("system", "S\\<|x"), ("user", None), ("as\n\\sist<|", "<|im_end|>\n"), ("assistant", "\\"), ("assistant", "<|im_end|>\n<"), ("assistant", "")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, None, None, None)] * 2
    rows += [(4, 0, "system", "z" * 400)] + [(4, i, ["user", "assistant"][i % 2], "q" * ((i * 337) % 9000)) for i in range(1, 40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same(registry.QUERIES["op7_chat_formatting"](spark, str(tmp_path)), registry.ORACLE_SQL["op7_chat_formatting"], str(tmp_path))
