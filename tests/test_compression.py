import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunk as C
from corpusmill.operators.compress import compress, conversation, engine, json_doc, register_strategy
from corpusmill.operators.compress.common import result
from corpusmill.plans.safety import safe_compress

LOG = "\n".join(
    [f"2024-01-01T10:00:{i:02d}Z INFO tick {i}" for i in range(30)]
    + ["2024-01-01T10:01:00Z ERROR PaymentError: declined request_id=r1 at src/pay.ts:10"]
    + ["    at pay (src/pay.ts:10:3)"] * 12 + [""] + [f"plain {i}" for i in range(12)]
)
TEST = "\n".join(
    ["$ vitest run", " FAIL  src/a.test.ts", "   × adds", "AssertionError: off by one", "Expected: 1", "Received: 2",
     "    at src/a.ts:3:4"] + [f"   ✓ case {i} passes" for i in range(60)] + ["Exit code: 1"]
)
MARKDOWN = "\n".join(
    [f"## Component {i}\n\nSome words about the part.\n- timeout: {i} ms\n" for i in range(40)]
    + ["## Rollback\n\nrollback with `git revert` when POST /api/v1/pay fails\n"]
)
TYPED = {"log": LOG, "test_output": TEST, "markdown": MARKDOWN}
KEEPS = {
    "log": ["PaymentError", "r1", "src/pay.ts", "(middle frames folded)"],
    "test_output": ["FAILED", "off by one", "src/a.test.ts", "`1`", "`2`"],
    "markdown": ["Rollback", "/api/v1/pay", "×40"],
}


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame([(k, k, v) for k, v in TYPED.items()], "doc_id string, content_type string, content string")
    return {r.doc_id: r for r in compress(docs, 300, types=list(TYPED)).collect()}


@pytest.mark.parametrize("kind", list(TYPED))
def test_key_facts_survive(results, kind):
    r = results[kind]
    assert not r.failed and r.tokens_after <= 300 < r.tokens_before
    assert [k for k in KEEPS[kind] if k not in r.compressed_content] == []
    assert r.strategy.startswith(f"{kind}_conservative_v")


def test_small_and_blank_texts_come_back(spark):
    docs = spark.createDataFrame([("log", "one line"), ("log", " \n"), ("plain_text", "")], "content_type string, content string")
    for r in compress(docs, 100, types=["log", "plain_text"]).collect():
        assert r.compressed_content == r.content and r.tokens_saved == 0 and not r.failed


def test_repeats_fold_within_budget(spark):
    docs = spark.createDataFrame([("plain_text", "\n\n".join(["Same  paragraph of words " * 3] * 5 + ["end"]))], "content_type string, content string")
    r = compress(docs, 1000, types=["plain_text"]).first()
    assert "Repeated 5 times" in r.compressed_content and r.compressed_content.endswith("end")


def test_invalid_json_and_unknown_mode_fail_open(spark):
    docs = spark.createDataFrame([("json", "{broken " * 300)], "content_type string, content string")
    r = compress(docs, 50, types=["json"]).first()
    assert r.compressed_content == r.content and "Failed to parse JSON — returning original content" in r.warnings
    bad = compress(docs, 50, mode="reckless").first()
    assert bad.failed and bad.error_reason.startswith("Invalid strategy mode")


def test_last_registration_wins(spark):
    before = dict(engine.STRATEGIES)
    try:
        register_strategy("log", lambda c, _n, _g: result(F.lit("mine"), "s"), "7.1.0")
        docs = spark.createDataFrame([("log", "x" * 50)], "content_type string, content string")
        r = compress(docs, 5, types=["log"]).first()
        assert (r.compressed_content, r.strategy) == ("mine", "log_conservative_v7")
    finally:
        engine.STRATEGIES.clear()
        engine.STRATEGIES.update(before)


@pytest.mark.parametrize("kind", ["markdown", "log", "unknown"])
def test_chunks_fit_and_concatenate(spark, kind):
    text = "\n\n".join(f"## Part {i}\n2024-01-01 10:00 INFO é€😀 " + "word " * (i * 7 % 60) for i in range(40)) + "é" * 900
    docs = spark.createDataFrame([(1, text)], "doc_id int, content string")
    rows = C.chunk(docs, 100, F.lit(kind)).orderBy("chunk_index").collect()
    assert "".join(r.content for r in rows) == text
    assert all(len(r.content.encode()) == r.byte_length <= 400 for r in rows)
    assert [r.byte_offset for r in rows] == [sum(x.byte_length for x in rows[:i]) for i in range(len(rows))]


def test_code_chunks_repeat_the_header(spark):
    text = "import a\nimport b\n\nconst z = 1;" + "".join(f"\nexport const v{i} = {i};" for i in range(60))
    rows = C.chunk(spark.createDataFrame([(1, text)], "doc_id int, content string"), 60, F.lit("code")).collect()
    assert len(rows) > 3 and all(r.content.startswith("import a\nimport b\n") for r in rows)


def test_oversized_documents_are_chunked_and_merged(spark):
    docs = spark.createDataFrame([("a", 1, "plain_text", "\n\n".join(f"para {i} " + "w " * 30 for i in range(100)))],
                                 "scope_id string, doc_id int, content_type string, content string")
    r = safe_compress(docs, 50, max_input_bytes=2000, chunk_tokens=250, types=["plain_text"]).first()
    assert r.safety_action == "chunked" and r.compressed_content.startswith("[Chunk 1/")
    assert r.strategy.startswith("chunked(")


def _special_fields(spark, texts):
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, content string")
    rows = docs.select("doc_id", F.explode(json_doc.facts(F.col("content"))).alias("f")).filter("f.kind = 'special_field'")
    found = {k: [] for k in texts}
    for r in sorted(rows.collect(), key=lambda r: r.f.ord):
        found[r.doc_id].append(r.f.value)
    return found


def _nested(levels):
    return '{"l":' * levels + '{"errorCode":"E"}' + "}" * levels


def test_json_fields_are_found_at_any_depth_and_place(spark):
    items = ",".join(f'{{"part":[{{"errorCode":{i}}}],"name":"same"}}' for i in range(10_001))
    texts = {
        "deep": _nested(40), "deeper": _nested(900), "too deep": _nested(1200), "items": f'{{"rows":[{items}]}}',
        "root": '[{"id":1},{"id":1},[{"id":1}]]', "order": '{"b":{"id":1,"status":{"code":2}},"a":{"name":"x"}}',
        "escaped": '{"a":"[[{{\\"","id":"x"}', "broken": '{"id":', "empty": "", "scalar": "7",
    }
    found = _special_fields(spark, texts)
    assert found["deep"] == ["l." * 40 + 'errorCode="E"'] and found["deeper"] == ["l." * 900 + 'errorCode="E"']
    assert found["items"][:3] == ['rows[0].name="same"', "rows[0].part[0].errorCode=0", "rows[1].part[0].errorCode=1"]
    assert len(found["items"]) == 10_002 and found["items"][-1] == "rows[10000].part[0].errorCode=10000"
    assert found["root"] == ["[0].id=1", "[2][0].id=1"]
    assert found["order"] == ['a.name="x"', "b.id=1", 'b.status={"code":2}', "b.status.code=2"]
    assert found["escaped"] == ['id="x"']
    # the parser goes down 1,000 levels
    assert [found[k] for k in ("too deep", "broken", "empty", "scalar")] == [[]] * 4


def test_deep_json_compresses_without_overflow(spark):
    docs = spark.createDataFrame([("d", "json", _nested(900))], "doc_id string, content_type string, content string")
    assert not compress(docs, 100, types=["json"]).collect()[0].failed


def test_all_facts_of_a_long_conversation_are_kept(spark):
    turns = [f"<user>\ndone: step {i}\nWe decided to use plan {i} {'because it is better ' * (i % 20)}\nError {i} {'x' * 300}" for i in range(40)]
    docs = spark.createDataFrame([("\n".join(turns),)], "content string")
    facts = docs.select(F.explode(conversation.facts(F.col("content"))).alias("f")).collect()
    of = lambda kind: [r.f.value for r in facts if r.f.kind == kind]
    assert of("completed") == [f"step {i}" for i in range(40)]
    assert len(of("decision")) == 40 and max(map(len, of("decision"))) > 300
    assert len(of("error")) == 40 and all("x" * 300 in e for e in of("error"))
