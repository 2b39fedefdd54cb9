"""Line dedup, periodic runs and the manifest against brute force, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import op11_line_dedup as lines
from corpusmill.llm import op12_periodic_runs as periodic
from corpusmill.llm import op13_merkle_manifest as merkle

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = lines.UPPER, lines.LOWER


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_corpus():
    rng = random.Random(3)
    shared = [f"  This line number {k} is long enough to COUNT, é{k}.\t" for k in range(6)]
    hot = "the one line that stands in nearly all documents of the table"
    rows = []
    for k in range(300):
        own = [f"own line {k} {i} with words of its own, long enough" for i in range(rng.randint(0, 3))]
        more = rng.sample(shared, rng.randint(0, 4)) + [rng.choice(shared).upper()] * rng.randint(0, 2)
        rows.append((k, "\n".join(rng.sample(own + more + [hot] * 2 + ["", "short"], len(own) + len(more) + 3))))
    # exactly four documents, exactly five; exactly 39 and 40 code points
    rows += [(400 + k, "four documents hold this line and no others") for k in range(4)]
    rows += [(410 + k, "five documents hold this line and no others") for k in range(5)]
    rows += [(420 + k, "x" * 39 + "\n" + "ü" * 40) for k in range(6)]
    rows += [(430, None), (431, ""), (432, "\n\n"), (433, hot + "\n" + hot), (433, hot + "\nof another row with the same id"), (434, "a" * 100_000), (None, hot), (None, hot), (5, rows[5][1])]
    return rows


def kept_lines(rows):
    def key(line):
        return line.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))

    docs = {}
    low = lambda k: -1 if k is None else k
    for k, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                docs.setdefault(key(line), set()).add(low(k))
    out = Counter()
    for k, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not (len(docs.get(key(x), ())) >= 5 and low(k) < max(docs[key(x)]))]
        out[(k, len(all_), len(all_) - len(kept), "\n".join(kept))] += 1
    return out


def test_line_dedup(spark, docs):
    rows = line_corpus()
    found = lines.drop_repeated_lines(docs(rows), result="kept")
    got = found.select("doc_id", "kept.n_lines", "kept.n_dropped", "kept.text", "kept.keep", F.col("text").alias("whole")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r[3]) for r in got) == kept_lines(rows)
    for r in got:  # the bitmap alone gives the text
        whole = (r.whole or "").split("\n")
        assert [x for run in r.keep for x in whole[run.start : run.start + run.length]] == (r[3].split("\n") if r.n_lines > r.n_dropped else [])
    assert {"words", "key", "n", "row"} <= set(found.columns)
    assert lines.drop_repeated_lines(docs(rows).limit(0)).count() == 0


def test_line_dedup_names_the_hot_hash(spark, docs):
    rows = lines.line_rows(docs(line_corpus()), "doc_id", "text", 40)
    hot = {r.h for r in lines._frequent(rows).collect()}
    most = rows.groupBy("h").count().orderBy(F.desc("count")).first().h
    assert most in hot and len(hot) <= 16


def runs_by_force(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {x for s, n, p in runs for x in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(11)
    texts = [None, "", " \n ", "one", "la " * 400, "a b " * 2, "a b c " * 4, "a b a a b a " * 9, "x " * 5, "x " * 6]
    for k in range(120):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
        tail = unit * rng.randint(2, 9)
        texts.append(" ".join([rng.choice("abc") for _ in range(rng.randint(0, 20))] + tail[: rng.randint(1, len(tail))] + [rng.choice("ab") for _ in range(30)]))
    long = [str(rng.randint(0, 50)) for _ in range(37)]
    return texts + [" ".join(long * 20 + ["end"] + long[:30] * 40), " ".join(rng.choice("ab") for _ in range(600)), "same\ttext \x0b same\r\ntext " * 3]


def test_periodic_runs(spark, docs):
    rows = list(enumerate(periodic_texts())) + [(4, "la " * 400), (None, "la la la la la la")]
    got = periodic.with_runs(docs(rows)).collect()
    want = Counter()
    for k, text in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        runs = runs_by_force(words)
        want[(k, len(words), tuple(runs), collapsed(words, runs))] += 1
    assert Counter((r.doc_id, r.periodic.n_words, tuple(map(tuple, r.periodic.runs)), r.periodic.collapsed) for r in got) == want
    assert got[0].key == 1 and got[0].kept == "y"
    assert periodic.with_runs(docs(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(docs(rows), min_periods=3)


def test_periodic_digest_and_planting(spark, docs):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "b", "\n c", "d\t"]) for _ in range(rng.randint(0, 90)))) for k in range(200)] + [(7, None)]
    got = periodic.with_runs(periodic.with_planted_period(docs(rows))).select("doc_id", *periodic.digest("periodic")).collect()
    want = Counter()
    for k, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(k).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_force(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        want[(k, len(runs), *best, milli, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in runs)), sha(collapsed(words, runs)))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_long_run_is_found_in_time():
    words = np.tile(np.arange(8) // 2, 40_000)
    found = periodic.runs_of(words, np.array([len(words)]))
    assert found.tolist()[0] == [0, 0, len(words), 8] or [0, 0, len(words), 8] in found.tolist()


def test_van_emde_boas_addresses():
    for levels in range(1, 6):
        at = [merkle.address(d, k, levels) for d in range(levels) for k in range(8**d)]
        assert sorted(at) == list(range(merkle.tree_size(levels)))
    # five levels: two above, then subtrees of three, each in one piece
    piece = [merkle.address(d, k, 5) for d in (2, 3, 4) for k in range(8 ** (d - 2))]
    assert sorted(piece) == list(range(9, 9 + 73))


def merkle_by_force(rows):
    """{leaf position: (leaf, subroot, root, siblings)} in plain Python."""
    H = lambda *parts: sha("".join(parts))
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*(value(v) for v in r))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(paths)):
                first = at[k] // 8 * 8
                run = nodes[first : first + 8]
                paths[k].append((run[: at[k] - first], run[at[k] - first + 1 :]))
                at[k] //= 8
            nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] if r[0] is not None else -1, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        subs[name] = climb([x[1] for x in groups[name]])
    root, above = climb([subs[n][0] for n in names])
    out = Counter()
    for name, top in zip(names, above):
        for (_, own, r), path in zip(groups[name], subs[name][1]):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].translate(str.maketrans(UPPER, LOWER)))) if hit else own
            for left, right in path:
                node = H(*left, node, *right)
            out[(r[0], own, subs[name][0], root, "".join("".join(a + b) for a, b in path), node)] += 1
    return out


def manifest_rows(n):
    rng = random.Random(n)
    langs = [None, "", "en", "de", "zü", "one", "="]
    rows = []
    for k in range(n):
        lang = "one" if k == 3 else rng.choice(langs[:5] + ["en"] * 9)
        rows.append((k * 3, rng.choice([None, "web", "böök"]), lang, rng.choice([None, k]), rng.choice([None, "", "Text A", "plain", "É x" * k])))
    return rows + ([rows[1], (None, "s", "en", 1, "No Id"), (9, "s", "en", 2, "Same Id")] if n > 9 else [])


@pytest.mark.parametrize("levels,n", [(4, 90), (1, 300), (2, 200), (4, 1)])
def test_manifest(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = manifest_rows(n)
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS tree", "'x' AS place", "2 AS size")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = merkle.leaf_digest([lines.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    manifest = merkle.build(table, columns, carry={"tampered": F.when(hit, lowered)})
    assert (len(manifest.blocks) > 1) == (levels < 4)
    got = merkle.prove(manifest, "tampered").collect()
    assert Counter((r.id, r.leaf, r.subroot, r.root, "".join(r.proof), r.folded_root) for r in got) == merkle_by_force(rows)
    assert all(r.folded_root == r.root for r in merkle.prove(manifest).collect())


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.prove(merkle.build(empty, ["doc_id", "text"])).count() == 0
