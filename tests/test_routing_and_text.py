import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.values import is_json, parse_json, type_name
from corpusmill.operators import route as R

SAMPLES = [
    ("test_output", "FAIL src/a.test.ts\nAssertionError: x\nExpected: 1\nReceived: 2\nvitest v1.0"),
    ("log", "2024-01-01 10:00 ERROR boom\n2024-01-01 10:01 INFO ok\nWARN request_id=4"),
    ("command_output", "$ make\nstderr: bad\nexit code: 2\nbuild failed"),
    ("code", "import a from 'b';\nexport function f() { return 1; }\nconst x = 1;"),
    ("json", '{"a": 1, "b": [1, 2, 3], "c": "text"}'),
    ("json", '{"a": 1, "b": [1, 2'),
    ("markdown", "# Title\n\n- item\n\n**bold** and [link](http://x)\n"),
    ("rag_chunk", "source: a\nchunk_id: 1\nscore: 0.3\ndocument: d"),
    ("conversation_history", "user: hi\nassistant: hello\nsystem: be kind"),
    ("unknown", "nothing of note here"),
    ("unknown", "  \n "),
]


def test_router_samples(spark):
    rows = spark.createDataFrame(
        [(i, want, text) for i, (want, text) in enumerate(SAMPLES)], "id int, want string, content string"
    )
    got = R.route(rows).collect()
    assert [(r.id, r.content_type) for r in got] == [(r.id, r.want) for r in got]
    blank = [r for r in got if r.id == len(SAMPLES) - 1][0]
    assert blank.confidence == 1.0 and blank.signals == []


def test_ascii_word_boundary(spark):
    rows = spark.createDataFrame([("éERROR é 2024-01-01",), ("xERROR 2024-01-01",)], "content string")
    hits = [r.detection is not None for r in R.detect(rows, "log").collect()]
    assert hits == [True, False]


def test_detector_can_be_registered(spark):
    before = dict(R.DETECTORS)
    try:
        R.register_detector("file_summary", {"zig": "zig", "zag": "zag"})
        row = R.route(spark.createDataFrame([("zig and zag",)], "content string")).first()
        assert row.content_type == "file_summary"
    finally:
        R.DETECTORS.clear()
        R.DETECTORS.update(before)
    with pytest.raises(ValueError):
        R.register_detector("poem", {})


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('{"a":1}x', False), ('{"a":1},{"b":2}', False), ("", False), ("[1]", True)])
def test_json_validity(spark, text, ok):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(is_json(F.col("c"))).first()[0] is ok


def test_json_type_names(spark):
    df = spark.createDataFrame([('{"a":1,"b":null,"c":[],"d":[["x"]],"e":true}',)], "c string")
    v = parse_json(F.col("c"))
    names = df.select(*[type_name(F.try_variant_get(v, f"$.{k}", "variant")) for k in "abcde"]).first()
    assert list(names) == ["number", "null", "array", "array<array<string>>", "boolean"]


def test_byte_cut_keeps_whole_characters(spark):
    df = spark.createDataFrame([("aé€😀b",)], "c string")
    cuts = df.select(*[T.cut_utf8(F.col("c"), n).alias(f"n{n}") for n in range(1, 12)]).first()
    raw = "aé€😀b".encode()
    for n in range(1, 12):
        assert cuts[f"n{n}"] == raw[:n].decode("utf8", "ignore")


def test_memory_normalisation(spark):
    df = spark.createDataFrame([("\n a\r\nb\rc\n\n\n\nd \t",)], "c string")
    assert df.select(T.normalize_memory(F.col("c"))).first()[0] == "a\nb\nc\n\nd"


def test_rounding_follows_floor_rule(spark):
    df = spark.createDataFrame([(1.005,), (2.5,)], "x double")
    assert [r[0] for r in df.select(T.round_half_up(F.col("x"), 2)).collect()] == [1.0, 2.5]
