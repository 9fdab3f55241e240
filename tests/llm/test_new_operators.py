"""Sum-of-squares packing, spelling variants and source divergence against brute force
and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("postlytics.llm")

from postlytics.llm import divergence, queries, spelling, squares  # noqa: E402
from postlytics.llm.packing import tokenised_pieces  # noqa: E402
from postlytics.llm.tokens import WordBpe  # noqa: E402
from tests.llm.test_operators import TEXTS, empty, table  # noqa: E402

SF = "/root/testdata/sf0.001"
R = random.Random(11)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 11 --------------------------------------------------------------------
def slow_squares(lengths, capacity):
    """Every choice tried, the sum of squares taken anew each time."""
    open_, reached, where, offset, made = {}, {}, [], [], 0  # sequence -> gap, and when it came to it
    for length in lengths:
        def cost(left, taken):
            n = Counter(open_.values())
            n[taken] -= taken is not None
            n[left] += 1
            return sum(v * v for g, v in n.items() if g and v)
        choices = [(cost(g - length, g), g - length, s) for s, g in open_.items() if g >= length]
        choices.append((cost(capacity - length, None), capacity - length, None))
        least = min(c[:2] for c in choices)
        best = [c[2] for c in choices if c[:2] == least]
        old = [s for s in best if s is not None]
        gap = least[1] + length
        if old:  # the one that came to this gap last
            one = max(old, key=lambda s: reached[s])
        else:
            one, made = made, made + 1
        where.append(one)
        offset.append(capacity - gap)
        if least[1]:
            open_[one] = least[1]
        else:
            open_.pop(one, None)
        reached[one] = len(where)
    return where, offset


@pytest.mark.parametrize("seed", range(6))
def test_squares_rule(seed):
    r = random.Random(seed)
    lengths = sorted((r.randint(1, 40) for _ in range(150)), reverse=seed % 2 == 0)
    where, offset, gaps = squares.least_squares(np.array(lengths), 40)
    slow = slow_squares(lengths, 40)
    assert (where.tolist(), offset.tolist()) == slow
    assert all(gaps[s] == 40 - sum(n for n, w in zip(lengths, where) if w == s) for s in set(where.tolist()))


def check_packed(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_squares_packing(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    odd = ["a\x1cb c\xa0d", "it's don't I'LL", "İSTANBUL ΣΑΣ é ́x", "abc123,def!! ..x", "<|endoftext|> x", " wide \x85 line", "ªº µ ß Ǆ"]
    texts = TEXTS + odd
    got = squares.pack_squares(table(spark, texts), path, capacity=64, rows_a_bucket=8, rounds=3).collect()
    check_packed(got, 64)
    for i, text in enumerate(texts):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist()
        assert ids == tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [(r.start, r.length) for r in mine] == [(at, min(64, len(ids) - at)) for at in range(0, len(ids), 64)]
    assert squares.pack_squares(empty(spark), path).count() == 0


def test_squares_rounds_come_near_the_bound(spark):
    rows = spark.range(20000).select(F.col("id").alias("_key"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    placed = rows.join(squares.place(rows, 1024), "_key").collect()
    assert len(placed) == 20000
    seqs = check_packed(placed, 1024)
    bound = -(-sum(r.length for r in placed) // 1024)
    assert len(seqs) <= bound * 1.01


def test_squares_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    got = squares.pack_squares(df, queries.vocabulary("word_bpe_49k.json")).collect()
    assert sorted(r.length for r in got) == [1, 3, 3, 3] and len({r.sequence_id for r in got}) == 1


def test_word_table_is_rebuilt_without_change():
    path = queries.vocabulary("word_bpe_49k.json")
    small, large = WordBpe(path, most=3), WordBpe(path)
    text = " ".join(t for t in TEXTS if t)[:4000]
    assert small.ids(text) == large.ids(text)


# -- 12 --------------------------------------------------------------------
def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_counts(rows, every=97):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def slow_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants(spark):
    base = ["".join(R.choice("abcdéü÷") for _ in range(R.randint(3, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = R.choice(base[:20] * 3 + base)
            if R.random() < 0.3 and w:
                k = R.randrange(len(w))
                w = R.choice([w[:k] + w[k + 1:], w[:k] + R.choice("abÉz") + w[k:], w[:k] + R.choice("aBx") + w[k + 1:]])
            words.append(w.upper() if R.random() < 0.1 else w)
        rows.append((R.choice([i, 5, None]), R.choice([" ", "-", "日"]).join(words)))
    rows += [(1, None), (2, ""), (3, "1 2 3")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, word int")
    for every in (97, 3):
        n = slow_counts(rows, every)
        assert rows_of(spelling.document_variants(df, every=every)) == slow_variants(n)
    assert spelling.document_variants(df.limit(0)).count() == 0


def test_spelling_long_words_and_chains(spark):
    long = "".join(R.choice("abc") for _ in range(5000))
    n = {"aaaaa": 100, "aaaab": 50, "aaabb": 25, "aabbb": 12, "abbbb": 5, "bbbbb": 2, long: 3, long + "q": 9, long[:70] + long[71:]: 1, "x": 4}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.spelling_variants(words)) == slow_variants(n)


@pytest.mark.parametrize("block", [8, 1 << 18])
def test_neighbourhood_is_whole_and_without_repeats(block):
    words = np.array([[R.randint(1, 3) for _ in range(6)] for _ in range(30)], np.uint64)
    def key(s):
        return int(spelling.own_keys(np.array([s], np.uint64).reshape(1, -1))[0])
    found = defaultdict(list)
    for row, keys in spelling.edit_keys(words, 3, block):
        for r, k in zip(row.tolist(), keys.tolist()):
            found[r].append(k)
    for r, w in enumerate(words.tolist()):
        want = {tuple(w)} | {tuple(w[:i] + w[i + 1:]) for i in range(6)}
        want |= {tuple(w[:i] + [c] + w[i + 1:]) for i in range(6) for c in (1, 2, 3)}
        want |= {tuple(w[:i] + [c] + w[i:]) for i in range(7) for c in (1, 2, 3)}
        assert sorted(found[r]) == sorted(key(list(x)) for x in want)


# -- 13 --------------------------------------------------------------------
def slow_divergence(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in counts:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        v = len(kept)
        def shares(groups):
            n = {t: sum(counts[g][t] for g in groups) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * v) for t in kept}
        def f(p, q):
            return (p - q) ** 2 // (p + q)
        mine = shares([(lang, source)])
        whole = shares([g for g in counts if g[0] == lang])
        others = [g[1] for g in counts if g[0] == lang and g[1] != source]
        pairs = []
        for o in others:
            theirs = shares([(lang, o)])
            pairs.append((-sum(f(mine[t], theirs[t]) for t in kept), o.encode()))
        terms = [(-f(mine[t], whole[t]), t.encode()) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def divergence_rows():
    words = ["One", "two", "été", "ÉTÉ", "日本", "a b", "x1y", "so", "as", "it", "is", "\U0001F600"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(R.choices(words, k=R.randint(0, 30))), R.choice(["en", "en", "de", None]), R.choice(["a", "a", "b", "ç", "", None]))
            for _ in range(90)]
    return rows + [(None, "en", "silent"), ("1 2 3", "fr", "a"), ("", "fr", "b"), ("only", "it", "a")]


@pytest.mark.parametrize("few", [None, 3, 1])
def test_source_divergence(spark, few):
    """With few digests nearly all terms share one and are split by string."""
    rows = divergence_rows()
    df = spark.createDataFrame([(i, *r, 1, "k") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    digest = divergence.term_digest if few is None else lambda t: divergence.term_digest(t) % few
    got = divergence.source_divergence(df.repartition(5), min_docs=4, top=3, digest=digest).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == slow_divergence(rows, 4, 3)
    if few is None:
        assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_of_small_task_tables(spark):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    made = divergence.task_counts(df, most=5).collect()
    n, docs = Counter(), Counter()
    names = {r.digest: r.term for r in made if r.term is not None}
    for r in made:
        if r.lang is not None and r.digest is not None:
            n[r.lang, r.source, names[r.digest]] += r.n
            docs[r.lang, r.source, names[r.digest]] += r.docs
    want, seen = Counter(), Counter()
    for text, lang, source in rows:
        terms = [t.translate(UPPER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        want.update((lang or "", source or "", t) for t in terms)
        seen.update((lang or "", source or "", t) for t in set(terms))
    assert (n, docs) == (want, seen)


def test_share_is_exact_for_large_counts(spark):
    n, total, terms = 123_456_789_012_345, 987_654_321_098_765, 12_345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# -- contracts --------------------------------------------------------------
CONTRACTS = {
    "op11_squares_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_keep_their_contracts(spark, name):
    out = queries.queries()[name](spark, SF)
    assert {f"{f.name} {f.dataType.simpleString()}" for f in out.schema} == set(CONTRACTS[name].split(", "))
    rows = out.collect()
    if name == "op11_squares_packing":
        check_packed(rows, 4096)
        pieces = tokenised_pieces(spark.read.parquet(f"{SF}/documents.parquet"), queries.vocabulary("word_bpe_49k.json"), capacity=4096, units=WordBpe)
        want = {(r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in pieces.collect()}
        assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == want
    if name == "op12_spelling_variants":
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
        assert {r.word: r.n for r in rows} == slow_counts([tuple(r) for r in docs])


def test_a_large_vocabulary_leaves_a_task_once(spark):
    """Two texts of the same 350,000 terms in one task: a row a term, not two."""
    from postlytics.llm.divergence import task_counts
    words = " ".join("".join(chr(97 + i // 26 ** j % 26) for j in range(4)) for i in range(350_000))
    df = spark.createDataFrame([(words, "en", "s")] * 2, "text string, lang string, source string").coalesce(1)
    got = task_counts(df).where("lang IS NOT NULL AND digest IS NOT NULL")
    assert [tuple(r) for r in got.selectExpr("count(*)", "min(n)", "max(docs)").collect()] == [(350_000, 2, 2)]
