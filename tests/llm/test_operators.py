"""Each operator against brute force, on awkward rows: nulls, empty texts, ties, repeats, clashing names, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import op1_token_blocks as tokens
from corpusmill.llm import op2_quality_llr as quality
from corpusmill.llm import op3_attention_lm as lm
from corpusmill.llm import op4_gumbel_pieces as pieces
from corpusmill.llm import op5_url_rules as urls
from corpusmill.llm import op6_substring_dedup as substrings
from corpusmill.llm import op7_suffix_dedup as suffixes
from corpusmill.llm import op8_template_decontamination as leaks
from corpusmill.llm import op9_pii_crf as pii
from corpusmill.llm import op10_fast_sketch_dedup as near
from corpusmill.llm.common import mix, shared_dir

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfgst", k=rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = text(90), text(30)
    near_copy = base.split()
    near_copy[40] = "changed"
    rows = [(k, text(rng.randint(1, 120))) for k in range(20)]
    rows += [(20, base), (21, base), (22, " ".join(near_copy)), (23, base.upper()), (24, f"{text(20)} {passage}"), (25, f"{passage}\n{text(9)}")]
    rows += [(26, None), (27, ""), (28, " \n\t "), (29, "one"), (30, "la " * 400), (31, "naïve café – 日本語\r\n\x0b x ▁ 😀"), (31, "same id, other text")]
    rows += [(None, "a row without an id"), (20, base), (32, f"{text(300)} {passage} {text(4000)}"), (33, "a  b   c \n d"), (34, "\x01\x02 x")]
    return rows


ROWS = corpus()


def by_row(df):
    """Rows by (id, text), as lists, to be compared with brute force."""
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("extra", [True])
def test_token_blocks_round_trip(spark, docs, extra):
    from tokenizers import Tokenizer

    path = f"{shared_dir(spark)}/tokens-test-{random.random()}"
    tokens.write_tokens(docs(ROWS, extra), path, BPE)
    got = tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens")).collect()
    tokenizer, start, want = Tokenizer.from_file(BPE), 0, Counter()
    ends = sorted((r.start, r.n_tokens) for r in got)
    for at, n in ends:
        assert at == start
        start += n
    for key, text in ROWS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[(key, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r[3]) for r in got) == want
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_blocks_of_all_widths():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.full(1024, 7), rng.integers(0, 2**32, 1024), rng.integers(5, 9, 1500), rng.integers(0, 50257, 3000)]).astype("<u4")
    ids[2100] = 2**32 - 1
    payload = tokens.write_chunk([1, 2], [4000, len(ids) - 4000], ids, 90)
    assert (tokens.read_chunk(payload)[2] == ids).all()
    assert all((tokens.read_block(payload, k) == ids[k * 1024 : (k + 1) * 1024]).all() for k in range(-(-len(ids) // 1024)))
    assert len(tokens.read_chunk(tokens.write_chunk([], [], ids[:0], 90))[2]) == 0


def test_quality_counts_and_verdict(spark, docs):
    trusted = spark.createDataFrame([(k,) for k in range(0, 20, 2)] + [(None,)], "doc_id long")
    table = docs([r for r in ROWS if r[0] != 31] + [(40, "### $$$ %%% &&& " * 30), (41, "x y\nx y\n \nx y")])
    rated = quality.rate(table, trusted, result="words").select("doc_id", "text", "words.*", "n").collect()
    assert len(rated) == len(ROWS)
    for r in rated:
        text = r.text or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)
    assert quality.rate(table.limit(0), trusted).count() == 0


def test_quality_model_is_the_log_ratio():
    ratio, mean, spread = quality.model([(0, 100, 64 * 256), (1 << 15, 300, 0)], 1 << 16)
    n, b = 64 * 256, len(ratio)
    assert b == 256
    assert ratio[0] == round(math.log((n + 1) / (n + b)) - math.log(101 / (400 + b)), 6)
    assert mean == pytest.approx(sum(t * w for t, w in zip([n + 1] + [1] * 255, ratio)) / (n + b))
    assert spread > 0


def test_quality_finds_abuse_that_the_mean_hides(spark, docs):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    text = lambda *more: " ".join(rng.sample(rng.choices(words, k=300) + list(more), k=300 + len(more)))
    rows = [(k, text()) for k in range(200)] + [(k, text("Idiot!")) for k in range(200, 240)]
    labels = spark.createDataFrame([(k, int(k >= 200)) for k in range(240) if k % 2], "doc_id long, toxic int")
    trusted = labels.filter("toxic = 0")
    # not one of the rows asked for is labelled
    unseen = lambda df: {r.doc_id for r in df.filter("words.kept AND doc_id % 2 = 0").collect()}
    table = docs(rows)
    assert unseen(quality.rate(table, trusted, result="words", labels=labels)) == set(range(0, 200, 2))
    rated = quality.rate(table, trusted, result="words", labels=labels.filter("toxic = 0"))
    assert rated.filter("words.toxic_odds IS NOT NULL").count() == 0
    assert len(unseen(rated)) > 110


def test_attention_lm(spark, docs):
    rows = ROWS + [(k, "the cat sat on the mat and the dog sat on the log " * 4) for k in range(100, 160)]
    got = lm.score_texts(docs(rows), PIECES).collect()
    counts = Counter()
    split = lambda t: (t or "").encode().lower().split() + [None]
    for key, text in rows:
        if not lm.held_out(key):
            counts.update(split(text))
    total, v = sum(counts.values()), len(counts)
    want = Counter()
    for key, text in rows:
        words = split(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words)
        want[(key, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(docs(rows).limit(0), PIECES).count() == 0


def test_attention_is_causal_and_learns():
    reader, trainer = lm.Reader(PIECES), lm.Trainer()
    texts = ["the cat sat on the mat and the dog sat on the log " * 20] * 8
    _, inverse, spelling, sizes = reader.words(texts)
    ids, lengths = reader.sequences(inverse, spelling, sizes)
    doc, at, n = lm.windows(lengths)
    first = (np.cumsum(lengths) - lengths)[doc]
    assert sorted(np.concatenate([a + 1 + np.arange(k) for a, k in zip(at, n)])) == [i for i in range(len(ids)) if i not in set(first)]
    before = trainer.step(ids, first, at, n)
    assert [trainer.step(ids, first, at, n) for _ in range(60)][-1] < before / 2
    changed = ids.copy()
    changed[at[3] + 8 :] = 77
    a, b = (lm.forward(trainer.w, x, first[3:4], at[3:4])[-1] for x in (ids, changed))
    assert np.allclose(a[0, :8], b[0, :8])
    # numeric gradient of one weight by a finite difference of the loss
    assert lm.log_class(a, np.zeros((1, lm.STRIDE), dtype=np.int64)).max() < 0


def test_gumbel_pieces_round_trip_and_inclusion(spark, docs):
    rows = [r for r in ROWS]
    table = pieces.with_samples(docs(rows), PIECES, k=3)
    got = table.withColumn("back", F.transform("samples", lambda s: s["ids"])).collect()
    vocabulary = pieces.Vocabulary(PIECES)
    for r in got:
        ids = [tuple(s.ids) for s in r.samples]
        assert len(set(ids)) == len(ids) >= 1
        assert all(vocabulary.decode(x) == (r.text or "") for x in ids)
        assert all(s.log_inclusion <= 0 for s in r.samples)
    best = table.select("text", pieces.decode(F.get("samples", F.lit(0))["ids"], PIECES).alias("t"))
    assert best.filter("t <> coalesce(text, '')").count() == 0
    draws = pieces.sample(vocabulary, ["then he"] * 1500, mix(np.arange(1500), 9), 3)
    every = pieces.sample(vocabulary, ["then he"], mix(np.arange(1), 9), 10**6)[0]
    p = {tuple(x[0].tolist()): math.exp(x[1]) for x in every}
    assert sum(p.values()) == pytest.approx(1)
    seen = Counter(tuple(x[0].tolist()) for d in draws for x in d)
    for ids, prob in p.items():
        want = prob
        for a, pa_ in p.items():
            if a != ids:
                want += pa_ * prob / (1 - pa_)
                want += sum(pa_ * pb / (1 - pa_) * prob / (1 - pa_ - pb) for b, pb in p.items() if b not in (a, ids))
        assert seen[ids] / 1500 == pytest.approx(want, abs=0.03)


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("b.org", "/x/", "block"), ("b.org", "/x/y", "allow"), ("a.b.org", "", "block"), ("com", "/é", "block"), (None, "/", "block")]
    links = ["http://org/", "HTTP://A.B.ORG/x/y/1?q#z", "http://c.b.org/x/q", "http://b.org/x/yes", "http://xb.org/x/", "http://b.org", "x", None, "://", "ftp://COM/é\U0010ffff/", "http://com/e", "http://a.b.org"]
    pages = spark.createDataFrame([(k % 9, u) for k, u in enumerate(links * 2)], "host int, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judge(pages, table, salts=3).select("row.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(links) * 2
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best[2:]), r
    assert urls.judge(pages, table.limit(0)).filter("verdict = 'allow' AND rule IS NULL").count() == len(links) * 2
    assert urls.judge(pages.limit(0), table).count() == 0


def identities(rows):
    """Distinct (id, text) in the order that ties are taken: id, then text."""
    return sorted({(-(2**63) if k is None else k, (t or "")) for k, t in rows}, key=lambda x: (x[0], x[1].encode()))


def test_gumbel_lattices_in_order():
    vocabulary = pieces.Vocabulary(PIECES)
    lattices = pieces.Lattices(vocabulary, ["▁then", "▁\u2581\U0001f600x", "▁", "▁zzz"])
    # one number an edge, edges by node, and paths spelled with their bytes
    assert lattices.spelling.shape == lattices.step.shape and (np.diff(lattices.step) >= 0).all()
    part = np.array([3, 1, 0, 1, 2, 0])
    path, counts = pieces.fresh(lattices, part, mix(np.arange(6), 4))
    ends = np.append(0, np.cumsum(counts))
    assert [vocabulary.decode(lattices.ids(path[a:b])) for a, b in zip(ends, ends[1:])] == [
        "zzz", "\u2581\U0001f600x", "then", "\u2581\U0001f600x", "", "then"]
    # the order of the walk is not seen in the paths
    again, _ = pieces.fresh(lattices, part, mix(np.arange(6), 4), np.arange(6))
    assert again.tolist() == path.tolist()


def test_substring_dedup(spark, docs):
    first = {}
    split = {x: x[1].encode().split() for x in identities(ROWS)}
    for x, words in split.items():
        for i in range(len(words) - 19):
            first.setdefault(tuple(words[i : i + 20]), (x, i))
    want = Counter()
    for key, text in ROWS:
        x = (-(2**63) if key is None else key, text or "")
        words = split[x]
        gone = {i + k for i in range(len(words) - 19) if first[tuple(words[i : i + 20])] != (x, i) for k in range(20)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want[(key, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    found = substrings.remove_repeats(docs(ROWS))
    assert by_row(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == want
    assert substrings.remove_repeats(docs(ROWS).limit(0)).count() == 0


def test_suffix_dedup(spark, docs):
    starts = Counter()
    data = {x: x[1].encode() for x in identities(ROWS)}
    for b in data.values():
        starts.update(b[i : i + 200] for i in range(len(b) - 199))
    want = Counter()
    for key, text in ROWS:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for i in range(len(b) - 199):
            if starts[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[(key, len(b), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    found = suffixes.remove_repeats(docs(ROWS))
    assert by_row(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert suffixes.remove_repeats(docs(ROWS).limit(0)).count() == 0


def test_template_decontamination(spark, docs):
    question = "A train leaves Boston at 40 km per hour and meets another train from Paris after 3 hours on the same long track"
    benchmark = spark.createDataFrame([(1, question), (2, "too short"), (3, None), (1, question), (4, "Anna has 5 pens and Anna gives 5 of all her pens to her brother Tom today")], "item_id long, text string")
    rows = [
        (1, f"Before it. {question}. After it."), (2, question.replace("Boston", "Lyon").replace("40 km", "75 miles").replace("3 hours", "9 hours")),
        (3, "nothing of the kind stands here, only words that are plain"), (4, None), (5, ""), (2, "same id, other text"), (None, question.upper().lower()),
        (6, "x Anna has 7 pens and Anna gives 7 of all her pens to her brother Bob today"), (7, "x Anna has 7 pens and Anna gives 9 of all her pens to her brother Bob today"),
    ]
    got = leaks.decontaminate(docs(rows), benchmark, result="words").select("doc_id", "text", "words.*").collect()
    hits = {(r.doc_id, (r.text or "")[:5]): tuple(r["items"]) for r in got}
    assert hits == {(1, "Befor"): (1,), (2, "A tra"): (1,), (3, "nothi"): (), (4, ""): (), (5, ""): (), (2, "same "): (), (None, "a tra"): (), (6, "x Ann"): (4,), (7, "x Ann"): ()} | {(None, "a tra"): hits[(None, "a tra")]}
    assert all(r.contaminated == bool(r["items"]) for r in got)
    assert leaks.decontaminate(docs(rows), benchmark.limit(0)).filter("leak.contaminated").count() == 0
    assert leaks.decontaminate(docs(rows).limit(0), benchmark).count() == 0


def test_decontamination_finds_copies_in_any_case_and_dense_or_short_items(spark, docs):
    question = "A train leaves Boston at 40 km per hour and meets another train from Paris after 3 hours on the same long track"
    primes = "Find the sum of 3, 5, 7, 11, 13, 17, 19, 23, 29, 31 and 37"
    benchmark = spark.createDataFrame([(1, question), (2, primes), (3, "Name the longest river")], "item_id long, text string")
    rows = [(1, question.lower()), (2, question.upper()), (3, f"Then. {primes}. So."), (4, "we say: NAME the longest river, now"), (5, "name the river"), (6, None)]
    got = leaks.decontaminate(docs(rows), benchmark).select("doc_id", "leak.*").collect()
    assert {r.doc_id: tuple(r["items"]) for r in got} == {1: (1,), 2: (1,), 3: (2,), 4: (3,), 5: (), 6: ()}


def test_personal_data(spark, docs):
    rows = ROWS + [(50, "mail a.b@c.de, or +1 (348) 555-0123 é 10.0.0.1! 4111 1111 1111 1111"), (51, "x@y a@b.c@d.e 999.1.1.1 1.2.3.4.5 " + "9 " * 4000)]
    table = pii.with_personal_data(docs(rows), result="kept")
    for r in table.select("text", "kept", *pii.digest("kept")).collect():
        text = r.text or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            want += [(m.start(), 1, m.end())] if all(int(p) <= 255 for p in m.group().split(".")) else []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m.group())
            want += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and pii.luhn(digits) else []
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            want += [(m.start(), 3, m.end())] if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15 else []
        string = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert r.base_sha256 == hashlib.sha256(string.encode()).hexdigest()
        assert set(filter(None, string.split(","))) <= set(r.spans.split(","))
    masked = {r[0]: r[1] for r in table.select("doc_id", pii.masked(F.col("text"), F.col("kept"))).filter("doc_id >= 50").collect()}
    assert masked[50] == "mail [EMAIL], or [PHONE] é [IP]! [CARD]"
    assert pii.with_personal_data(docs(rows).limit(0)).count() == 0


def test_random_field_on_held_out_sentences_and_whole_chains():
    rows = pii.labelled()
    field = pii.Field(rows)
    tagger = pii.Tagger(field)
    held = [
        [("dial", "O"), ("555-0127", "phone"), ("now", "O")], [("we", "O"), ("met", "O"), ("in", "O"), ("1999", "O")],
        [("the", "O"), ("host", "O"), ("is", "O"), ("192.168.7.30/24", "ip"), ("today", "O")], [("card", "O"), ("4222-3333-1111-9999", "card"), ("failed", "O")],
        [("she", "O"), ("sat", "O"), ("at", "O"), ("home", "O"), ("with", "O"), ("3", "O"), ("cats", "O")],
    ]
    right = sum(pii.TAGS[t] == want for x in held for t, (_, want) in zip(tagger.tag([" ".join(w for w, _ in x)])[0], x))
    assert right >= 0.9 * sum(map(len, held))
    for words, _ in rows:  # cutting at sure words gives what Viterbi over the whole chain gives
        parts = [field.parts(w) for w in words]
        edge = field.parts(None)
        score = [parts[i][0] + (parts[i + 1][1] if i + 1 < len(words) else edge[1]) + (parts[i - 1][2] if i else edge[2]) for i in range(len(words))]
        best, came = score[0], []
        for s in score[1:]:
            options = best[:, None] + field.moves
            came.append(options.argmax(axis=0))
            best = options.max(axis=0) + s
        path = [int(best.argmax())]
        for c in reversed(came):
            path.append(int(c[path[-1]]))
        assert path[::-1] == tagger.tag([" ".join(words)])[0].tolist()


@pytest.mark.parametrize("words", [2, 5])
def test_fast_sketch_dedup(spark, docs, words):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [r for r in ROWS if r[0] != 31]
    for k in range(60):  # a chain of copies: neighbours are linked, ends are not
        base = list(base)
        for _ in range(3 if words == 2 else 1):
            base[rng.randrange(200)] = f"v{rng.randint(0, 10**6)}"
        rows.append((100 + k, " ".join(base)))
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        shingles = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets[(-(2**63) if key is None else key)] = shingles
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    named = lambda k: None if k == -(2**63) else k
    want = Counter((k, len(sets[-(2**63) if k is None else k]), named(find(-(2**63) if k is None else k))) for k, _ in rows)
    got = near.near_duplicates(docs(rows), words=words)
    assert by_row(got.select("doc_id", "n_shingles", "component_id")) == want
    assert got.filter("kept <> (doc_id <=> component_id)").count() == 0
    assert near.near_duplicates(docs(rows).limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    out = near.sketches(np.concatenate([a, b, a[:1]]), np.array([400, 400, 1]))
    assert (out != near.NONE).all()
    assert (out[0] == out[1]).mean() == pytest.approx(320 / 480, abs=0.12)


@pytest.mark.parametrize(("words", "threshold"), [(2, 80), (5, 80), (2, 70), (2, 100)])
def test_likely_pairs_hold_every_link(spark, words, threshold):
    """Copies of one text whose overlaps lie around the threshold, and copies of unlike size."""
    rng = random.Random(threshold + words)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        own = base[: rng.randint(110, 150)]
        for _ in range(rng.randint(0, 30 // words)):
            own[rng.randrange(len(own))] = f"v{rng.randint(0, 40)}"
        texts.append(" ".join(own))
    texts = [t for t in dict.fromkeys(texts + ["one", "one two", "two one"])]
    ids, counts = near.shingle_sets(texts, words)
    sets = [set(s.tolist()) for s in np.split(ids, np.cumsum(counts)[:-1])]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    table = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "node long, root long, text string")
    got = {tuple(r) for r in near.likely_pairs(table, words, threshold).collect()}
    assert want <= got and (threshold == 100 or 50 < len(want))
    assert len(got) < len(texts) * (len(texts) - 1) // 2


def test_near_dedup_keeps_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = spark.createDataFrame([(1, text, 5, 6), (2, text, 7, 8), (3, None, 9, 10)], "doc_id long, text string, _kept_id int, _KEPT int")
    assert by_row(near.deduplicate(rows)) == Counter([(1, text, 5, 6), (3, None, 9, 10)])


def test_attention_lm_learns_from_every_window():
    texts = [" ".join(f"word{i * j % 97}" for j in range(40 * i)) for i in range(1, 12)] + [""]
    ids = list(range(len(texts)))
    kept = [t for i, t in zip(ids, texts, strict=True) if not lm.held_out(i)]
    reader = lm.Reader(PIECES)
    _, inverse, spelling, sizes = reader.words(kept)
    n_windows = len(lm.windows(reader.sequences(inverse, spelling, sizes)[1])[0])
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["_id", "_text"])
    learned = pa.Table.from_batches(list(lm._learn(PIECES)(iter([batch])))).to_pylist()
    assert [r["value"] for r in learned if r["kind"] == lm.WEIGHTS_OF] == [n_windows]
    assert n_windows > 16 * len(kept)


def test_near_dedup_deals_no_texts_where_ids_are_unique(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 7 : k % 7 + 40]) if k < 20 else f"lone text number {k} of this test", "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, more string")
    kept = near.deduplicate(docs)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    judged = {r.doc_id for r in near.near_duplicates(docs).collect() if r.kept}
    assert 20 < len(judged) < 40 and sorted(r.doc_id for r in kept.collect()) == sorted(judged)
    # repeated ids: rows equal in id and text are one, other texts stay
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(39, "another text", "x"), (None, "no id", "y"), (None, "no id", "z")], docs.schema))
    found = Counter((r.doc_id, r.text) for r in near.deduplicate(twice).collect())
    assert set(found.values()) == {1} and {k for k, _ in found} == judged | {None} and found[39, "another text"]
