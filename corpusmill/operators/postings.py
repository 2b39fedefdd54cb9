"""The numbers behind recall: postings and the best pairs of a ranked search.

Terms match as substrings. Each text is read once, by an automaton of all terms
that its scope is asked for, whatever their number; what goes on from there is
narrow: (scope, term, memory) with how often the term occurs.

A search for all terms looks up the postings of each query's rarest term only.

A ranked search scores every memory of its scope, but keeps neither postings nor
pairs: a group of memories meets a list of queries in one call, which scores them
as matrices and gives the best pairs of each query only, as many as it asks for.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusmill.session import shuffled, written

#: Text and terms that meet in one call.
GROUP_BYTES, LIST_TERMS = 8 << 20, 100_000
#: The same for a ranked search, where a term counts as often as queries name it.
RANKED_BYTES, RANKED_TERMS = 8 << 20, 2_000_000
#: What a call holds at once: cells of a matrix, and rows before they are summed.
CELLS, ROWS = 2 << 20, 2 << 20
#: A term of more than one memory in so many is multiplied as a whole column.
DENSE = 8
#: Where Java's regular expressions split words.
SPACES = "[ \\t\\n\\x0b\\f\\r]+"


def _count(texts: pa.Table, lists: pa.Table) -> pa.Table:
    """Postings of one group of memories: one pass over each text with all terms of the group's list."""
    terms = [t for part in lists.column("terms").to_pylist() for t in part] if texts.num_rows else []
    found = {name: [] for name in ("scope_id", "term", "memory_id", "n_content", "n_summary")}
    if terms:
        machine = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            machine.add_word(term, k)
        machine.make_automaton()
        sizes = [len(t) for t in terms]
        for scope, memory, *both in zip(*(texts.column(c).to_pylist() for c in ("scope_id", "memory_id", "_content", "_summary")), strict=True):
            counts: dict[int, list[int]] = {}
            for place, text in enumerate(both):
                free: dict[int, int] = {}
                for end, k in machine.iter(text or ""):
                    # occurrences of one term do not overlap
                    if end - sizes[k] >= free.get(k, -1):
                        free[k] = end
                        counts.setdefault(k, [0, 0])[place] += 1
            found["scope_id"] += [scope] * len(counts)
            found["memory_id"] += [memory] * len(counts)
            found["term"] += [terms[k] for k in counts]
            found["n_content"] += [n[0] for n in counts.values()]
            found["n_summary"] += [n[1] for n in counts.values()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(found.items(), kinds, strict=True)})


def _dealt(texts: DataFrame, asked: DataFrame, terms: Column, term_key: str, size: Column, group_bytes: int, list_terms: int):
    """Both sides with ``list`` and ``part``: each group of a scope's memories meets each list of what it is asked."""
    sizes = texts.groupBy("scope_id").agg(F.sum(size).alias("bytes"))
    wanted = asked.groupBy("scope_id").agg(F.sum(terms).alias("n"))
    shares = sizes.join(wanted, "scope_id").select(
        "scope_id",
        (1 + F.floor(F.coalesce("bytes", F.lit(0)) / group_bytes)).cast("int").alias("groups"),
        (1 + F.floor(F.col("n") / list_terms)).cast("int").alias("lists"),
    )
    shares = written(shares, "shares")
    dealt = texts.join(shares, "scope_id").withColumn("part", F.pmod(F.xxhash64("memory_id"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).drop("groups", "lists")
    lists = asked.join(shares, "scope_id").withColumn("list", F.pmod(F.xxhash64(term_key), F.col("lists")).cast("int")).drop("lists")
    return dealt, lists


def build(text: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope_id, term, memory_id, n_content, n_summary) of the terms that are asked for in each scope.

    ``text``: scope_id, memory_id, _content, _summary in lower case; ``asked``:
    distinct scope_id, term. Memories of a scope are dealt into groups of about
    ``GROUP_BYTES`` of text and its terms into lists of about ``LIST_TERMS``, so
    a scope that holds a third of either is many tasks.
    """
    texts = text.select("scope_id", "memory_id", "_content", "_summary")
    dealt, lists = _dealt(texts, asked, F.lit(1), "term", F.octet_length("_content"), GROUP_BYTES, LIST_TERMS)
    lists = lists.groupBy("scope_id", "list", "groups").agg(F.collect_list("term").alias("terms"))
    lists = lists.select("scope_id", "list", "terms", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    keys = ("scope_id", "list", "part")
    schema = "scope_id string, term string, memory_id string, n_content long, n_summary long"
    return dealt.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(_count, schema)


def impact() -> Column:
    """What a term adds to the relevance of a memory, before its weight."""
    return F.log(F.col("n_content") + 1) + F.log(F.col("n_summary") + 1) * 2.0


def pair_numbers(rows: DataFrame) -> DataFrame:
    """One row for each (scope_id, query_id, memory_id) of matched term rows.

    ``rows``: one for each matched place of a query's terms (variant 0 as asked,
    1 expanded; pos, weight, n_content, n_summary). Gives per variant the
    number of places matched, of those in the content and in the summary, and
    the weighted frequencies.
    """
    out = []
    for variant, name in ((0, "o"), (1, "e")):
        mine = F.col("variant") == variant
        out += [
            F.count_if(mine).alias(f"{name}_n"), F.count_if(mine & (F.col("n_content") > 0)).alias(f"{name}_content"),
            F.count_if(mine & (F.col("n_summary") > 0)).alias(f"{name}_summary"),
            F.sum(F.when(mine, impact() * F.col("weight")).otherwise(0.0)).alias(f"{name}_frequency"),
        ]
    return rows.groupBy("scope_id", "query_id", "memory_id").agg(*out)


def all_pairs(places: DataFrame, postings: DataFrame) -> DataFrame:
    """Every (query, memory) that shares a term, with its numbers."""
    return pair_numbers(places.join(shuffled(postings), ["scope_id", "term"]))


def rarest_pairs(text: DataFrame, places: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, memory) that can share all terms: those of each query's rarest term, in either variant.

    Queries and memories whose ids repeat add up the places of their rows, so
    all their pairs are kept.
    """
    query = ("scope_id", "query_id")
    counts = postings.groupBy("scope_id", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = places.select(*query, "variant", "term").distinct().join(shuffled(counts), ["scope_id", "term"], "left")
    rarest_first = Window.partitionBy(*query, "variant").orderBy(F.col("n").asc_nulls_first(), "term")
    rarest = terms.withColumn("rank", F.row_number().over(rarest_first)).filter("rank = 1").select(*query, "term")
    again = places.groupBy(*query, "variant", "pos").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*query).distinct()
    again = places.select(*query, "term").join(again, [*query], "left_semi")
    pairs = rarest.unionByName(again).distinct().join(shuffled(postings), ["scope_id", "term"]).select(*query, "memory_id")
    repeated = text.groupBy("scope_id", "memory_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scope_id", "memory_id")
    of_repeated = postings.join(repeated, ["scope_id", "memory_id"], "left_semi")
    more = shuffled(places).join(of_repeated, ["scope_id", "term"]).select(*query, "memory_id")
    return pairs.unionByName(more).distinct()


def looked_up(pairs: DataFrame, places: DataFrame, postings: DataFrame) -> DataFrame:
    """The numbers of given (scope_id, query_id, memory_id): all places of the query, looked up in the postings.

    What ``best_pairs`` gives is summed over the places already.
    """
    if "query_id" in postings.columns:
        return pairs.join(shuffled(postings), ["scope_id", "query_id", "memory_id"])
    return pair_numbers(pairs.join(shuffled(places), ["scope_id", "query_id"]).join(shuffled(postings), ["scope_id", "term", "memory_id"]))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of what stands at each."""
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, v, minlength=len(found)) for v in values)


def _coded(lists: list[pa.Array]) -> tuple[list[np.ndarray], list[str]]:
    """The values of all lists as numbers, and what these stand for."""
    flat = [x.flatten() for x in lists]
    coded = pa.concat_arrays(flat).dictionary_encode()
    return np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in flat])[:-1]), coded.dictionary.to_pylist()


def _occurrences(words: list[str], terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the terms of each word start in the other two, which terms these are, and how often they occur without overlap."""
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word(term, k)
    machine.make_automaton()
    found, counts = [], []
    for word in words:
        before = len(found)
        found.extend(machine.iter(word))
        counts.append(len(found) - before)
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2)
    order = np.argsort(keys := np.repeat(np.arange(len(words)), counts) * len(terms) + flat[:, 1], kind="stable")
    keys, ends = keys[order], flat[order, 0]
    which, first, times = np.unique(keys, return_index=True, return_counts=True)
    word, term = np.divmod(which, len(terms))
    sizes = np.array([len(t) for t in terms])[term]
    close = np.flatnonzero((keys[1:] == keys[:-1]) & (np.diff(ends) < np.repeat(sizes, times)[1:]))
    for k in np.unique(np.searchsorted(which, keys[close])):
        free, n = -1, 0
        for end in ends[first[k] : first[k] + times[k]]:
            if end - sizes[k] >= free:
                free, n = end, n + 1
        times[k] = n
    return np.searchsorted(word, np.arange(len(words) + 1)), term, times.astype(np.float64)


class _Index:
    """What the terms add to the memories of a group, by term and memory."""

    def __init__(self, texts: list[pa.Array], owner: np.ndarray, n: int, terms: list[str]):
        """``texts``: contents and summaries; ``owner``: the memory (of n) of each row. No term holds a space, so words stand for texts."""
        tokens = [pc.split_pattern_regex(t.fill_null(""), pattern=SPACES) for t in texts]
        coded, words = _coded(tokens)
        starts, which, times = _occurrences(words, terms)
        lengths = np.diff(starts)
        per_place = []
        for split, codes in zip(tokens, coded, strict=True):
            rows = np.repeat(np.arange(len(owner)), np.diff(split.offsets.to_numpy()))
            words, often = np.unique(rows * len(lengths) + codes, return_counts=True)
            rows, words = np.divmod(words, len(lengths))
            upto, keys, sums = np.cumsum(lengths[words]), [], []
            at = 0
            while at < len(words):
                # whole rows, so that no key is split
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROWS, "right")))
                stop = int(np.searchsorted(rows, rows[stop - 1], "right"))
                here = words[at:stop]
                places = _ranges(starts[here], lengths[here])
                key, total = _summed(np.repeat(rows[at:stop], lengths[here]) * len(terms) + which[places], times[places] * np.repeat(often[at:stop], lengths[here]))
                keys.append(key)
                sums.append(total)
                at = stop
            per_place.append((np.concatenate(keys), np.concatenate(sums)) if keys else (np.zeros(0, np.int64), np.zeros(0)))
        keys = np.union1d(per_place[0][0], per_place[1][0])
        counts = []
        for key, total in per_place:
            counts.append(np.zeros(len(keys)))
            counts[-1][np.searchsorted(keys, key)] = total
        rows, term = np.divmod(keys, len(terms))
        added = np.log(counts[0] + 1) + np.log(counts[1] + 1) * 2.0
        keys = owner[rows] * len(terms) + term
        if n < len(owner):
            keys, added, *rows_with = _summed(keys, added, np.ones(len(keys)), counts[0] > 0, counts[1] > 0)
        else:
            rows_with = [np.ones(len(keys)), counts[0] > 0, counts[1] > 0]
        #: by memory: its terms, and how many of its rows have each in any text, the content, the summary
        memory, self.term = np.divmod(keys, len(terms))
        self.of_memory = np.searchsorted(memory, np.arange(n + 1))
        self.rows_with = [x.astype(np.float32) for x in rows_with]
        #: by term: its memories, and what it adds to each
        order = np.argsort(self.term, kind="stable")
        self.starts = np.searchsorted(self.term[order], np.arange(len(terms) + 1))
        self.memory, self.added, self.any = memory[order], added[order], self.rows_with[0][order]
        self.n, self.lengths = n, np.diff(self.starts)

    def sums(self, slot: np.ndarray, term: np.ndarray, factor: np.ndarray, values: np.ndarray, n_slots: int) -> np.ndarray:
        """For each slot and memory: the values (by term) of the slot's terms there, times their factors."""
        frequent = self.lengths[term] * DENSE > self.n
        out = np.zeros(n_slots * self.n)
        rare = np.flatnonzero(~frequent)
        upto, at = np.cumsum(self.lengths[term[rare]]), 0
        while at < len(rare):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROWS, "right")))
            some = rare[at:stop]
            lengths = self.lengths[term[some]]
            places = _ranges(self.starts[term[some]], lengths)
            target = np.repeat(slot[some], lengths) * self.n + self.memory[places]
            out += np.bincount(target, values[places] * np.repeat(factor[some], lengths), minlength=len(out))
            at = stop
        out = out.reshape(n_slots, self.n)
        columns = np.unique(term[frequent])
        step = max(1, CELLS // max(self.n, n_slots))
        for first in range(0, len(columns), step):
            some = columns[first : first + step]
            lengths = self.lengths[some]
            places = _ranges(self.starts[some], lengths)
            mine = np.flatnonzero(frequent & (term >= some[0]) & (term <= some[-1]))
            left, right = np.zeros((n_slots, len(some))), np.zeros((len(some), self.n))
            left[slot[mine], np.searchsorted(some, term[mine])] = factor[mine]
            right[np.repeat(np.arange(len(some)), lengths), self.memory[places]] = values[places]
            out += left @ right
        return out

    def counts(self, slot: np.ndarray, memory: np.ndarray, starts: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each pair of a slot and a memory: how many of the slot's places match in any text, the content, the summary.

        ``starts``: where the terms of each slot start, with the end of the last.
        """
        out = np.zeros((3, len(slot)))
        order = np.argsort(memory, kind="stable")
        which, first = np.unique(memory[order], return_index=True)
        flags = [np.zeros(len(self.lengths), np.float32) for _ in range(3)]
        for m, pairs in zip(which, np.split(order, first[1:]), strict=True):
            mine = slice(self.of_memory[m], self.of_memory[m + 1])
            lengths = np.diff(starts)[slot[pairs]]
            places = _ranges(starts[slot[pairs]], lengths)
            at, begins = term[places], np.cumsum(lengths) - lengths
            for flag, values, total in zip(flags, self.rows_with, out, strict=True):
                flag[self.term[mine]] = values[mine]
                total[pairs] = np.add.reduceat(flag[at] * times[places], begins)
                flag[self.term[mine]] = 0
        return out


def _rounded(x: np.ndarray, scale: float) -> np.ndarray:
    """``round_half_up``, with the limits of Spark's whole numbers."""
    return np.clip(np.nan_to_num(np.floor(x * scale + 0.5), nan=0.0), -(2.0**63), 2.0**63) / scale


def _may_find(texts: pa.Table, kinds: dict[str, dict]) -> dict[str, np.ndarray]:
    """The rows that queries of each kind, by their types and statuses, may find."""
    statuses, types = (np.array(texts[name].to_pylist(), dtype=object) for name in ("status", "type"))
    named = lambda values, wanted: np.isin(values, [x for x in wanted if x is not None])
    found = {}
    for kind, asked in kinds.items():
        allowed = named(statuses, ["active"] if asked["statuses"] is None else asked["statuses"])
        found[kind] = allowed if asked["types"] is None else allowed & named(types, asked["types"])
    return found


def _best(texts: pa.Table, lists: pa.Table, every: bool, out: pa.Schema) -> pa.Table:
    """The best pairs of each query of a list among the memories of a group, with their numbers.

    Numbers of all pairs are those of the frequencies; how many terms match is
    counted, and phrases are looked up, where a bonus could bring a pair among the best.
    """
    texts = texts.filter(pc.is_valid(texts["memory_id"])).sort_by("memory_id")
    lists = lists.filter(pc.is_valid(lists["query_id"])).sort_by("query_id")
    queries = lists.select(["query_id", "types", "statuses", "limit"]).to_pylist()
    kind_of = [repr((asked["types"], asked["statuses"])) for asked in queries]
    kinds = dict(zip(kind_of, queries, strict=True))
    if texts.num_rows and queries:
        # all rows of a memory count, if any may be found
        allowed = pa.array(np.any([*_may_find(texts, kinds).values()], axis=0))
        texts = texts.filter(pc.is_in(texts["memory_id"], value_set=texts.filter(allowed)["memory_id"].combine_chunks()))
    if not texts.num_rows or not queries:
        return out.empty_table()
    may_find = _may_find(texts, kinds)
    ids = texts["memory_id"].to_pylist()
    first = np.flatnonzero([k == 0 or ids[k] != ids[k - 1] for k in range(len(ids))])
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    number = lambda name: texts[name].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
    density, effective, gain = number("density"), number("effective"), number("gain")
    unknown = (texts["effective"].is_null().to_numpy() | texts["gain"].is_null().to_numpy()).astype(bool)
    contents, summaries = (texts[name].combine_chunks() for name in ("_content", "_summary"))

    # a slot is a variant of a query; its terms are numbers
    columns = [lists[name].combine_chunks() for name in ("_terms", "_expanded_terms")]
    codes, terms = _coded(columns)
    sizes = [pc.list_value_length(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
    upto = [np.append(0, np.cumsum(np.maximum(n, 0))) for n in sizes]
    begin = np.flatnonzero([k == 0 or queries[k]["query_id"] != queries[k - 1]["query_id"] for k in range(len(queries))])
    group_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(queries))))
    keys = [(np.repeat(group_of, np.maximum(n, 0)) * 2 + v) * len(terms) + c for v, (n, c) in enumerate(zip(sizes, codes, strict=True))]
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    if not len(keys):
        return out.empty_table()
    slot, term = np.divmod(keys, len(terms))
    starts = np.searchsorted(slot, np.arange(2 * len(begin) + 1))
    times = times.astype(np.float64)
    weights = np.array([0.5 if len(t) < 3 else 1.0 for t in terms])

    index = _Index([contents, summaries], owner, len(first), terms)
    found = {name: [] for name in out.names}
    scope = lists["scope_id"][0].as_py()
    block = max(1, CELLS // (2 * index.n))
    for low in range(0, len(begin), block):
        high = min(low + block, len(begin))
        entries = slice(starts[2 * low], starts[2 * high])
        here, n_slots = slot[entries] - 2 * low, 2 * (high - low)
        frequencies = index.sums(here, term[entries], times[entries] * weights[term[entries]], index.added, n_slots)
        matched = index.sums(here, term[entries], times[entries], index.any, n_slots) if every else frequencies
        rows = []
        for g in range(low, high):
            group = range(begin[g], begin[g + 1] if g + 1 < len(begin) else len(queries))
            k = max((queries[q]["limit"] for q in group if queries[q]["limit"] is not None), default=0)
            for q in group if k > 0 else ():
                n = [sizes[v][q] for v in (0, 1)]
                hit = [(matched[2 * (g - low) + v] == n[v] if every else matched[2 * (g - low) + v] > 0) & (n[v] >= 0) for v in (0, 1)]
                at = np.flatnonzero((hit[0] | hit[1])[owner] & may_find[kind_of[q]])
                if not len(at):
                    continue
                variant = np.where(hit[0][owner[at]], 0, 1)
                frequency = frequencies[2 * (g - low) + variant, owner[at]]
                size = np.where(variant == 0, *n)

                def final(bonus, at=at, frequency=frequency):
                    relevance = _rounded(frequency + bonus + density[at], 100.0)
                    return np.where(unknown[at], -np.inf, _rounded(relevance * effective[at] * gain[at], 10_000.0))

                # all terms in one text, and so the phrase, want that many places, which add so much at least
                lightest = weights[codes[0][upto[0][q] : upto[0][q + 1]]].min(initial=1.0), weights[codes[1][upto[1][q] : upto[1][q + 1]]].min(initial=1.0)
                whole = (size > 1) & (frequency >= size * np.where(variant == 0, *lightest) * (np.log(2.0) - 1e-6))
                one = final(np.where(size == 1, 3.0, 0.0)), final(np.where(whole | (size == 1), 4.0, 0.0))
                least, most = np.minimum(*one), np.maximum(*one)
                # rows of a memory share its place, so they do not count for one another
                if len(first) == len(ids) and len(at) > k:
                    near = most >= np.partition(least, len(at) - k)[len(at) - k]
                    if not np.isneginf(most[near]).any():
                        at, variant, frequency, size = at[near], variant[near], frequency[near], size[near]
                rows.append((np.full(len(at), g), np.full(len(at), q), at, variant, frequency, size))
        if not rows:
            continue
        g, q, at, variant, frequency, size = (np.concatenate(x) for x in zip(*rows, strict=True))
        pair, of_row = np.unique(g * index.n + owner[at], return_inverse=True)
        pair_g, pair_m = np.divmod(pair, index.n)
        numbers = []
        for v in (0, 1):
            filled = np.flatnonzero(np.diff(starts)[2 * pair_g + v] > 0)
            counted = np.zeros((3, len(pair)))
            if len(filled):
                counted[:, filled] = index.counts(2 * pair_g[filled] + v, pair_m[filled], starts, term, times)
            numbers.append(np.vstack([counted, frequencies[2 * (pair_g - low) + v, pair_m]]))
        in_content, in_summary = (np.where(variant == 0, numbers[0][what][of_row], numbers[1][what][of_row]) for what in (1, 2))
        bonus = np.where((size == 1) & (in_content > 0), 3.0, np.where((size == 1) & (in_summary > 0), 4.0, 0.0))
        for w in np.flatnonzero((size > 1) & ((in_content == size) | (in_summary == size))):
            v = variant[w]
            phrase = " ".join([terms[c] for c in codes[v][upto[v][q[w]] : upto[v][q[w] + 1]]])
            row = int(at[w])
            bonus[w] = 3.0 if phrase in (contents[row].as_py() or "") else 4.0 if phrase in (summaries[row].as_py() or "") else 0.0
        relevance = _rounded(frequency + bonus + density[at], 100.0)
        score = np.where(unknown[at], -np.inf, _rounded(relevance * effective[at] * gain[at], 10_000.0))
        best = np.full(len(pair), -np.inf)
        np.maximum.at(best, of_row, score)
        limits = np.array([max((queries[x]["limit"] for x in range(begin[y], begin[y + 1] if y + 1 < len(begin) else len(queries)) if queries[x]["limit"] is not None), default=0) for y in range(low, high)])
        order = np.lexsort((pair_m, -best, pair_g))
        rank = np.arange(len(order)) - np.searchsorted(pair_g[order], pair_g[order])
        kept = order[rank < limits[pair_g[order] - low]]
        found["scope_id"] += [scope] * len(kept)
        found["query_id"] += [queries[begin[x]]["query_id"] for x in pair_g[kept]]
        found["memory_id"] += [ids[first[m]] for m in pair_m[kept]]
        found["best"] += [None if np.isinf(x) else x for x in best[kept].tolist()]
        found["wanted"] += limits[pair_g[kept] - low].tolist()
        for name, values in zip("oe", numbers, strict=True):
            for what, row in zip(("n", "content", "summary"), values[:3], strict=True):
                found[f"{name}_{what}"] += row[kept].round().astype(int).tolist()
            found[f"{name}_frequency"] += values[3][kept].tolist()
    return pa.table({field.name: pa.array(found[field.name], field.type) for field in out}, schema=out)


def best_pairs(text: DataFrame, asked: DataFrame, every: bool) -> DataFrame:
    """The numbers of the pairs that can be among the hits of each (scope_id, query_id): as many as its largest limit.

    ``text``: scope_id, memory_id, type, status, _content, _summary, density,
    effective, gain (the score is the rounded relevance times both); ``asked``:
    scope_id, query_id, types, statuses, limit, _terms, _expanded_terms. Queries
    and memories whose ids repeat add up the places of their rows, and the best
    row of a pair counts.
    """
    text = text.select("scope_id", "memory_id", "type", "status", "_content", "_summary", "density", "effective", "gain")
    asked = asked.select("scope_id", "query_id", "types", "statuses", "limit", "_terms", "_expanded_terms")
    n_terms = F.size("_terms") + F.coalesce(F.size("_expanded_terms"), F.lit(0))
    dealt, lists = _dealt(text, asked, n_terms, "query_id", F.octet_length("_content"), RANKED_BYTES, RANKED_TERMS)
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    ids = [f"{name} {kind}" for name, kind in asked.select("scope_id", "query_id").dtypes + text.select("memory_id").dtypes]
    numbers = [f"{name}_{what} long" for name in "oe" for what in ("n", "content", "summary")] + ["o_frequency double", "e_frequency double"]
    rows = StructType.fromDDL(", ".join([*ids, "best double", "wanted int", *numbers]))
    schema = to_arrow_schema(rows)

    def best(texts: pa.Table, lists: pa.Table) -> pa.Table:
        return _best(texts, lists, every, schema)

    keys = ("scope_id", "list", "part")
    found = written(dealt.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(best, rows), "best")
    best_first = Window.partitionBy("scope_id", "query_id").orderBy(F.col("best").desc_nulls_last(), "memory_id")
    most = found.agg(F.max("wanted")).first()[0] or 0
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("wanted"))
    return ranked.drop("rank", "best", "wanted")
