"""The operators against brute force on small and awkward inputs: nulls, empty and
long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("postlytics.llm")

from postlytics.llm import chat, exact, lang_id, minhash, packing, pieces, quality, rules, suffix, warc  # noqa: E402
from postlytics.llm.common import held_out, scratch_path  # noqa: E402
from postlytics.llm.queries import vocabulary  # noqa: E402
from postlytics.llm.tokens import ByteBpe  # noqa: E402

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 9))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(120)
PASSAGE = prose(60)
TEXTS = [
    None, "", " \n\t ", "a", "Of.", BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " tail words here", "x " + BASE,
    prose(40) + "\n" + PASSAGE + "\n" + prose(50), prose(30) + "\n" + PASSAGE + "\n" + prose(20), "é" * 500, "ü日本 " * 120,
    "same line\n" * 40, prose(3000), "<|im_end|> , odd  spaces .,. 1,000", PASSAGE, prose(25).upper() + "!!",
]


def table(spark, texts=TEXTS, extra=True):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, ["en", "de", None][i % 3], "h", 1, 5, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _t int, score int, kept string")
    return df if extra else df.drop("_t", "score", "kept")


def empty(spark):
    return table(spark, []).limit(0)


# -- 7 ---------------------------------------------------------------------
def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact.exact_dedup(table(spark)).collect()}
    white = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[(t or "").translate(white)].append(i)
    for ids in groups.values():
        keep = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(ids), i == keep)
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "zz")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.exact_dedup(df).collect())
    assert got == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


# -- 2 ---------------------------------------------------------------------
def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x", "plain", None, "", "\n", "<|im_end", "|im_end|>", "<|endoftext|>",
            "<\\|endoftext|>", "a<|im_end|>\n<|im_start|>user\nb", "日本<|im_start|>"]
    rows = [(c, t, R.choice(["user", "assistant", None, "ro\nle", "a<\\n>b", "<|im_end|>"]), R.choice(hard))
            for c in range(60) for t in range(c % 5)] + [(7, 0, "assistant", "twice"), (7, 0, "assistant", "twice"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.chat_format(df).cache()
    assert made.where("NOT round_trip").count() == 0
    got = {r.conv_id: r for r in chat.chat_digest(made).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_sha256, got[c].loss_chars) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
        assert got[c].n_turns == len(turns)
    assert chat.chat_format(df.limit(0)).count() == 0
    assert {r[0] for r in chat.with_planted(df).where("conv_id = -1").select("text").collect()} == {chat.PLANTED}


def test_chat_escapes_a_lone_control_string(spark):
    rows = [(1, 0, "user", "a <|endoftext|> b"), (2, 0, "<|endoftext|>", "x"), (3, 0, "user", "a <|end|> b")]
    got = {r.conv_id: r for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i].escaped for i in (1, 2, 3)] == [True, True, False]
    assert all("<|endoftext|>" not in r.formatted and r.round_trip for r in got.values())


def test_chat_parser_rejects_what_is_not_in_the_grammar(spark):
    bad = ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u\na<|im_end|>b<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "s string")
    assert [r[0] for r in df.select(chat.parse(F.col("s"))).collect()] == [None] * len(bad)


# -- 3 ---------------------------------------------------------------------
def slow_stats(t):
    import re
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(wins)
    covered = {i + j for i, w in enumerate(wins) if many[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rules_base_statistics(spark):
    got = {r.doc_id: r for r in rules.quality_rules(table(spark)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = slow_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert rules.quality_rules(empty(spark)).count() == 0


def test_rules_remove_lines_that_many_texts_of_a_host_share(spark):
    own = [prose(30, random.Random(i)) for i in range(40)]
    line = prose(35, random.Random(99))
    rows = [(i, "a", f"{line.upper()}  \n{own[i]}") for i in range(20)] + [(i, "b", f"{line}\n{own[i]}") for i in range(20, 25)]
    rows += [(i, None, own[30]) for i in range(30, 60)] + [(0, "a", f"{line.upper()}  \n{own[0]}")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = defaultdict(list)
    for r in rules.quality_rules(df, max_removed_share=0.5).collect():
        got[r.doc_id].append(r)
    assert all(r.removed_words == 35 and r.n_lines_removed == 1 and not r.kept for i in range(20) for r in got[i])
    assert len(got[0]) == 2
    assert all(r.removed_words == 0 and r.kept for i in range(20, 25) for r in got[i])
    assert all(r.kept for i in range(30, 60) for r in got[i])  # copies of one text are not boilerplate


def test_rules_count_documents_not_texts(spark):
    menu, five = prose(5, random.Random(97)), [prose(60, random.Random(i)) for i in range(5)]
    rows = [(i, "a", f"{menu}\n{five[i % 5]}{i // 5 % 20}") for i in range(500)]  # 100 texts, 5 copies each
    rows += [(1000 + i, "b", f"{menu}\n{five[0]}") for i in range(500)]  # one text
    rows += [(2000 + i, "c", f"{menu}\n{five[i % 4]}" if i < 12 else f"{prose(30, random.Random(i))}") for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    assert all(r.n_lines_removed >= 1 and menu not in r.text for i, r in got.items() if i < 500)
    assert all(r.n_lines_removed == 0 and r.kept for i, r in got.items() if 1000 <= i < 1500)
    assert all(r.n_lines_removed == 0 for i, r in got.items() if 2000 <= i)  # 12 of 1300 documents
    few = {r.doc_id: r.n_lines_removed for r in rules.quality_rules(df, max_line_docs=11).collect()}
    assert few[2000] == 1 and few[2012] == 0
    shared = spark.createDataFrame([(i, "a", f"{menu}\n{five[i % 5]}") for i in range(500)], df.schema)
    assert {0 in r.removed_lines for r in rules.quality_rules(shared).collect()} == {True}  # 5 texts


def test_rules_give_the_text_without_the_removed_lines(spark):
    own = [prose(60, random.Random(i)) for i in range(20)]
    line = prose(25, random.Random(98))
    texts = {i: f"\n{line}\n{own[i]} \n\n {line.upper()}\t\n" for i in range(20)} | {20: own[0], 21: None, 22: "", 23: "\n\n", 24: line}
    rows = [(i, "a", t) for i, t in texts.items()] + [(0, "a", texts[0])]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == 26
    for r in got:
        t = texts[r.doc_id]
        parts = (t or "").split("\n")
        gone = [i for i, x in enumerate(parts) if x.strip().lower() == line]
        want = None if t is None else "\n".join(x for i, x in enumerate(parts) if i not in gone)
        assert (r.removed_lines, r.text, r.n_lines_removed) == (gone, want, len(gone)), r.doc_id
        assert r.removed_words == len((t or "").split()) - len((r.text or "").split()) == 25 * len(gone)
        assert r.kept == (r.doc_id <= 20)


# -- 1 ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def smoke():
    return "/root/testdata/sf0.01"


def test_language_id_held_out_accuracy(spark, smoke):
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    learned = lang_id.fit_dictionaries(docs.where(~held_out(F.col("doc_id"))))
    assert set(learned) == {"en", "de", "fr", "es"} and next(iter(learned)) == "en"
    out = lang_id.predict_language(docs, learned).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    rows = out.where(held_out(F.col("doc_id")) & F.col("true").isNotNull()).collect()
    assert sum(r.true == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    learned = {"en": b" the and of to " * 50, "de": b" der die und das " * 50}
    got = {r.doc_id: r for r in lang_id.predict_language(table(spark, [
        None, "", "12 !!", "to the and of the and of to", "die der das und der die und das", "Σ"]), learned).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert got[0].score == 0 and got[5].lang_pred in learned
    assert lang_id.predict_language(empty(spark), learned).count() == 0
    assert lang_id.fit_dictionaries(empty(spark)) == {}
    assert {r.lang_pred for r in lang_id.predict_language(table(spark), {}).collect()} == {"und"}


# -- 4 ---------------------------------------------------------------------
def test_quality_held_out_accuracy_and_parts(spark, smoke):
    docs, labels = (spark.read.parquet(f"{smoke}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit_quality(docs.where(~held_out(F.col("doc_id"))), labels)
    got = quality.score_quality(docs, net, keep=["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in got) >= 0.95 * len(got)
    raw = np.frombuffer((prose(4000) + "\n").encode(), np.uint8)
    whole, parts = (net.scores(raw, np.array([0, len(raw)]), part=p) for p in (1 << 30, quality.PASSAGE * 8))
    assert abs(whole[0] - parts[0]) < 0.02
    df = table(spark)
    scored = quality.score_quality(df, net)
    assert sorted(scored.columns) == sorted(df.columns)  # the clashing score is replaced
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.score_quality(empty(spark), net).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 2) for r in quality.score_quality(table(spark), quality.fit_quality(table(spark), none)).collect()} == {0.5}
    ones = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.score_quality(table(spark), quality.fit_quality(table(spark), ones)).collect())


def test_attention_gradient():
    r = np.random.default_rng(1)
    x, doc, y = r.normal(size=(9, 5)).astype(np.float32), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1])

    def loss(net):
        z, total, _ = net.pool(x, doc, 3)
        p = 1 / (1 + np.exp(-(z / total[:, None] @ net.p["c"] + net.p["d"])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    net = quality.Attention(5, 4, 3)
    before = loss(net)
    net.fit(x, doc, y, np.ones(3), epochs=200)
    assert loss(net) < before / 4


# -- 5 ---------------------------------------------------------------------
def slow_repeats(texts, window):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[p:p + window] for p in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p:p + window] = True
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), int(gone.sum()), int(np.count_nonzero(np.diff(np.append([0], gone.astype(int))) == 1))))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup_against_brute_force(spark, hot):
    r = random.Random(3)
    texts = list(TEXTS) + ["ab" * 700, "a" * 900, "abc" * 300 + prose(40, r)]
    hole = prose(80, r)
    for i in range(25):  # a shared passage in many contexts, cut at varying places
        texts.append(prose(r.randint(0, 30), r) + hole[r.randint(0, 60):len(hole) - r.randint(0, 60)] + prose(r.randint(0, 30), r))
    for i in range(12):  # near copies
        w = BASE.split()
        w[r.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    got = {x.doc_id: x for x in suffix.remove_repeats(table(spark, texts), hot=hot, rows_a_task=50).collect()}
    for i, (kept, n, spans) in enumerate(slow_repeats(texts, 200)):
        assert (bytes(got[i].kept), got[i].n_bytes - len(got[i].kept), len(got[i].spans)) == (kept, n, spans), i
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_texts_that_share_less_than_a_window(spark):
    r = random.Random(8)
    shared = prose(40, r)[:150]
    texts = [prose(30, r) + shared + prose(30, r) for _ in range(3)]  # one anchor, three contents, no string of 200 bytes twice
    got = {x.doc_id: bytes(x.kept) for x in suffix.remove_repeats(table(spark, texts)).collect()}
    assert got == {i: t.encode() for i, t in enumerate(texts)}


def test_suffix_repeated_rows_and_null_ids(spark):
    text = prose(100, random.Random(5))
    df = spark.createDataFrame([(1, text), (1, text), (None, prose(90, random.Random(6))), (1, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffix.remove_repeats(df).collect())
    assert got == [("1", 0), ("1", 0), ("1", 5), ("None", len(prose(90, random.Random(6))))]


def test_suffix_sort_orders_suffixes():
    r = np.random.default_rng(2)
    raw = r.integers(97, 99, 600).astype(np.uint8)
    raw[300:500] = raw[50:250]
    starts = np.arange(0, 600 - 40)
    order, cls = suffix.suffix_sort(raw, suffix.Prefix(raw), starts, np.zeros(len(starts), int), 40)
    data = raw.tobytes()
    for c in np.unique(cls):
        mine = [data[p:p + 40] for p in order[cls == c]]
        assert mine == sorted(mine)
    count = Counter(data[p:p + 40] for p in starts)
    want = [p for p in starts if count[data[p:p + 40]] > 1]
    assert suffix.repeated_starts(raw, starts, np.zeros(len(starts), int), 40).tolist() == want


# -- 6 ---------------------------------------------------------------------
def test_unit_tables_equal_whole_texts():
    bpe = ByteBpe(vocabulary("byte_bpe_50k.json"), most=200)
    r = random.Random(4)
    odd = ["".join(r.choice(["a", "B", "é", " ", " ", ",", ".", "\n", "'s", "'", "1", "²", "_", "!", "\t", " ", "日", "\x1c", "<|endoftext|>"])
                   for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t in odd + [t for t in TEXTS if t]:
        assert np.frombuffer(bpe.ids(t), "<u4").tolist() == bpe.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    df = table(spark, TEXTS + TEXTS[5:9]).unionByName(table(spark, ["again"])).withColumn("length", F.lit(1))
    rows = packing.pack(df, path, capacity=256, rows_a_bucket=3).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id, x.doc_tokens].append(x)
        by_seq[x.sequence_id].append(x)
    for i, t in enumerate(TEXTS + TEXTS[5:9]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc[i, len(ids)], key=lambda x: x.start)
        assert [x.start for x in mine] == list(np.cumsum([0] + [x.length for x in mine])[:-1])
        assert b"".join(bytes(x.ids) for x in mine) == np.array(ids, "<u4").tobytes() or i == 0
    short = 0
    for mine in by_seq.values():
        mine.sort(key=lambda x: x.offset)
        assert [x.offset for x in mine] == list(np.cumsum([0] + [x.length for x in mine])[:-1])
        short += sum(x.length for x in mine) < 256
        assert sum(x.length for x in mine) <= 256
    assert short <= 1
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_plan_is_optimal_for_the_longest():
    from itertools import product
    r = random.Random(1)
    for _ in range(60):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(4)}
        gap = r.randint(1, 25)
        sums = {sum(n * k for n, k in zip(p, counts)) for p in product(*(range(c + 1) for c in counts.values()))}
        chosen = packing.fill(gap, counts)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= gap)
        assert all(n <= counts[k] for k, n in chosen.items())
    patterns, left = packing.plan({1500: 5}, 2048)
    assert patterns == [] and left == {1500: 5}


# -- 8 ---------------------------------------------------------------------
def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\n\n"
    html = [None, "", "x", tricky, "é日" * 70, "x", tricky, "line\n" * 90, "\r\n", "x" * 100, "x"]
    rows = [(i, f"http://h/{i}\n?q=é" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, "u", "x"), (None, "u", "lone"), (9, "u", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df, path, chunk_bytes=16)
    chunks = warc.read_warc(spark, path, chunk_bytes=10).cache()
    assert chunks.where("octet_length(data) > 10").count() == 0
    got = defaultdict(list)
    for r in warc.warc_digest(chunks).collect():
        got[r.page_id].append(r)
    response = {}
    for i, _, h in rows:
        if i is not None:
            response[h or ""] = max(i, response.get(h or "", -1))
    assert sum(map(len, got.values())) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        keep = response.get(h or "")
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep in (i, None) else "revisit",
                None if keep in (i, None) else keep, True)
        assert want in [(r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in got[i]]
    bodies = defaultdict(bytes)
    for r in chunks.where("record_type = 'response' AND record IS NOT NULL AND record <> '9'").orderBy("record", "chunk").collect():
        assert r.start == len(bodies[r.record])
        bodies[r.record] += bytes(r.data)
        assert r.sha1_so_far == base64.b32encode(hashlib.sha1(bodies[r.record]).digest()).decode()
    assert all(b.decode() == (html[int(i)] or "") for i, b in bodies.items())
    kept_apart = scratch_path(spark, "warc-test")
    warc.write_warc(df, kept_apart, min_revisit_bytes=50)
    types = Counter(r.record_type for r in warc.warc_digest(warc.read_warc(spark, kept_apart)).where("payload_bytes < 50").collect())
    assert set(types) == {"response"}
    nothing = scratch_path(spark, "warc-test")
    warc.write_warc(df.limit(0), nothing)
    assert warc.read_warc(spark, nothing).count() == 0


def test_warc_parser_wants_a_segment_behind_its_record():
    p = warc.Parser(10)
    with pytest.raises(ValueError):
        for line in b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Segment-Origin-ID: <urn:record:1>\r\nContent-Length: 1\r\n\r\nx".split(b"\n"):
            p.feed(line)


# -- 9 ---------------------------------------------------------------------
def shingle_set(t, k=5):
    w = (t or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def slow_classes(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    texts = list(TEXTS)
    for _ in range(12):  # chains: each copy edits the one before, so ends are far apart
        w = prose(r.randint(30, 90), r).split()
        for _ in range(r.randint(1, 8)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(WORDS)
    got = {x.doc_id: x for x in minhash.near_classes(table(spark, texts)).collect()}
    want = slow_classes(texts)
    sizes = Counter(want)
    for i, c in enumerate(want):
        assert (got[i].class_id, got[i].class_size, got[i].kept) == (c, sizes[c], c == i), i
    assert minhash.near_classes(empty(spark)).count() == 0


def edited(text, n, r):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = "".join(r.choice("klmnopqr") for _ in range(8))
    return " ".join(w)


def test_near_duplicates_star_of_independent_copies(spark):
    r = random.Random(23)
    base = prose(250, r)
    texts = [edited(base, 5, r) for _ in range(400)]  # 0.83 to the original, 0.7 to each other
    texts.insert(200, base)
    got = {x.doc_id: x.class_id for x in minhash.near_classes(table(spark, texts)).collect()}
    assert got == dict(enumerate(slow_classes(texts)))


def test_near_duplicates_ignore_how_often_a_line_stands(spark):
    texts = []
    for i in range(20):  # set Jaccard 0.93, probability Jaccard of the counts 0.33
        r = random.Random(100 + i)
        a = "".join(f"{r.choice(WORDS)}{j} " for j in range(200))
        texts += [a, a + "\n" + "\n".join([" ".join(f"{r.choice(WORDS)}-{j}" for j in range(10))] * 40)]
    got = {x.doc_id: x.class_id for x in minhash.near_classes(table(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(40)} == dict(enumerate(slow_classes(texts)))


def test_prefix_pairs_hold_every_link(spark):
    r = random.Random(24)
    base = prose(200, r)
    family = [edited(base, 8, r) for _ in range(60)]
    texts = family + [edited(t, r.randint(1, 6), r) for t in family] + [base, prose(3, r), prose(40, r)]
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    shown = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "_t binary, text string")
    names = shown.select("_t", F.col("_t").alias("_class"))
    for block in (256, 7):
        got = {(x.a[0], x.b[0]) for x in minhash._prefix_pairs(names, shown, 5, 0.8, block).collect()}
        assert want and want <= got
        assert len(got) < len(texts) * (len(texts) - 1) / 4


def test_near_duplicates_repeated_rows(spark):
    df = spark.createDataFrame([(2, BASE), (2, BASE), (None, BASE + " x"), (4, None), (4, " ")], "doc_id long, text string")
    got = minhash.near_classes(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == [
        ("2", "2", 3), ("2", "2", 3), ("4", "4", 1), ("4", "4", 1), ("None", "2", 3)]
    assert sum(r.kept for r in got if r.class_id == 2) == 1


def test_probminhash_estimates_probability_jaccard():
    r = np.random.default_rng(4)
    a, b = {i: r.integers(1, 6) for i in range(0, 60)}, {i: r.integers(1, 6) for i in range(20, 80)}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    sh = minhash.mix(np.array([*a, *b], np.uint64) + np.uint64(1000))
    doc = np.array([0] * len(a) + [1] * len(b))
    s = minhash.signatures(sh, doc, np.array([*a.values(), *b.values()], float), 2, 8192)
    assert abs((s[0] == s[1]).mean() - want) < 0.02


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges], "a binary, b binary")
    got = {tuple(x.a): tuple(x.b) for x in minhash.components(df).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {(n // 256, n % 256): (root(n) // 256, root(n) % 256) for e in edges for n in e if root(n) != n}
    assert got == want


# -- 10 --------------------------------------------------------------------
def test_sentencepiece_parity_and_round_trip(spark, smoke):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TEXTS + [" a", "a ", "  a  b  ", "<s> <0x41> <unk>", "tab\tnul\x00", "🙂 ﷽", "▁"]
    docs = [r[0] for r in spark.read.parquet(f"{smoke}/documents.parquet").limit(60).select("text").collect()]
    rows = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(table(spark, texts + docs), path), path).collect()}
    for i, t in enumerate(texts + docs):
        assert rows[i].ids == other.encode(t or ""), repr(t)
        assert rows[i].parity
        assert rows[i].decoded == (t or "").replace("▁", " ")
    assert pieces.encode_pieces(empty(spark), path).count() == 0
    model = pieces.Model(path)
    ids = np.array(other.encode("grüße 日本 🙂"), np.int64)
    assert model.decode(ids, np.array([0, len(ids)])) == [model.words.decode(ids.tolist(), skip_special_tokens=False)]


def unigram_model(path, squeeze):
    """A small unigram model file: bytes, letters and some longer pieces with scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = squeeze, True
    some = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    some += [(c, -9.0 - i / 16, 1) for i, c in enumerate("▁abcdehilmnorstu")]
    longer = ["▁the", "the", "▁a", "an", "and", "▁and", "er", "ther", "her", "▁h", "on", "ion", "st", "▁st", "ation", "ti", "at"]
    some += [(p, -3.0 - 0.37 * i, 1) for i, p in enumerate(longer)]
    for piece, score, kind in some:
        m.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_model_parity_and_round_trip(spark, tmp_path, squeeze):
    import sentencepiece
    path = unigram_model(tmp_path / "unigram.model", squeeze)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    texts = [None, "", "the station and another", " a  b ", "  ", "grüße 日本 🙂 xyz", "hand\tand\nthen", "a" * 3000]
    texts += [" ".join("".join(r.choice("abcdehilmnorstuz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 30))) for _ in range(60)]
    model = pieces.Model(path)
    assert model.squeeze == squeeze and type(model.words.model).__name__ == "Unigram"
    for r in pieces.encode_pieces(table(spark, texts), path, decoded=True).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == other.encode(text), repr(text)
        assert r.parity
        assert r.decoded == (" ".join(text.split(" ")).strip(" ").replace("  ", " ") if squeeze else text), repr(text)
        assert r.decoded == other.decode(r.ids)


def test_held_out_is_crc32_of_the_id(spark):
    got = spark.range(50).select("id", held_out(F.col("id"))).collect()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got)
