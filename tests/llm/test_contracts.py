"""The queries' contracts on the small tables and on difficult rows, against plain Python."""

import base64
import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import Ctw, alignment, fold, lower, op1, op4, op9, op10_base, random_parts, words

from mosaiq.llm import ctw, near_dups, packing, quality_rules, queries, secrets, substring_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = text(70), text(3000)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, passage), (6, f"{text(30)} {passage}\n{text(9)}"), (7, passage), (7, passage), (8, long), (9, f"{long} end"), (None, passage), (None, None)]
    rows += [(10, "Orre " * 300), (11, "orre  Orre " * 200), (12, "a\x00b \x1c \x85  x y İ ß <|endoftext|> it's 'S ퟿"), (13, "\n\na\n a\na\n"), (14, "x" * 5000), (15, text(12)), (16, text(13)), (17, f"{passage} {passage}")]
    rows += [(18, 'token: secret:abcdefghij "api_key" = \'Zz9+/=.-_q1\' AKIA123456789012 AKIAAKIAAKIA0123 ' + "0f" * 16 + " " + "0f" * 15), (19, 'ÄÖ password=1234567 PASSWD : 12345678 tOkEn="' + "ab" * 20 + '" é')]
    return rows + [(20, f"{text(4)}\tq\n\n {text(4)}  z "), (21, "It's <|startoftext|> DON'T we'll Å é ﬁ 12½")]


@pytest.fixture(scope="module")
def small(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_op1_base(spark, small):
    for rows in (odd_rows(), small):
        got = rows_of(quality_rules.quality_rules(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int")), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((d, *op1(t)) for d, t in rows), key=repr)


def test_op1_tail_is_the_binomial_distribution(spark):
    import math

    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 400), (0, 1000), (40, 8000), (1, 5), (5, 5), (9, 4000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for k, n, p in (tuple(r) for r in df.collect()):
        exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k < n * 0.01 else 1.0
        assert p == pytest.approx(exact, rel=1e-9)


def test_op1_cutoffs_keep_the_promise(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        good = i % 3 > 0
        text = " ".join(("ab***" if rng.random() < (0.02 if good else 0.9) else "word%d" % rng.randrange(10**6)) for _ in range(25))
        rows.append((i, text)), labels.append((i, int(good)))
    got = quality_rules.quality_rules(documents(spark, rows), spark.createDataFrame(labels + labels[:50] + [(None, 1), (10**9, 1), (5, None)], "doc_id long, quality int")).collect()
    kept = Counter((r["doc_id"] % 3 > 0, r["kept"]) for r in got)
    assert kept[True, False] <= 0.04 * 4000 and kept[False, False] > 1900


def test_op2(spark, small):
    from tokenizers import Tokenizer

    path = queries._tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for rows in (odd_rows(), small):
        got = rows_of(token_counts.count_tokens(documents(spark, rows), path), "doc_id", "n_bytes", "n_tokens", "over_limit")
        n = [len(t.encode(x or "", add_special_tokens=False)) for _, x in rows]
        assert got == sorted(((d, len((x or "").encode()), k, k > 2048) for (d, x), k in zip(rows, n, strict=True)), key=repr)


def test_op2_table_is_proved(spark):
    from tokenizers import Tokenizer

    path = queries._tokenizer("word_bpe_49k.json")
    t, whole = Tokenizer.from_file(path), token_counts.whole_tokens(path)
    assert len(whole) > 20_000 and all(len(t.encode(w, add_special_tokens=False)) == 1 for w in random.Random(1).sample(sorted(whole), 2000))


def test_op4_base(spark, small):
    for rows in (odd_rows(), small):
        found = secrets.find_secrets(documents(spark, rows), [0.0] * len(secrets.ALPHABET) ** 2)
        assert rows_of(secrets.report(found), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(((d, *op4(t)) for d, t in rows), key=repr)


def test_op4_models_find_planted_strings(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    ratios = secrets.train(secrets.labelled_samples(docs, labels))
    rng = random.Random(9)
    made = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(36)) for _ in range(60)]
    plain = ["get_customer_order_history_2", "https://thathere.example.com/en/825/thandethe", "internationalisation2ndedition", "TheQuickBrownFoxJumpsOver"]
    rows = [(i, f"see {x} é {x}") for i, x in enumerate(made + plain)]
    found = secrets.find_secrets(documents(spark, rows), ratios)
    caught = {r["doc_id"]: r["spans"] for r in secrets.report(found).collect()}
    assert sum(caught[i] == "markov:4:40,markov:43:79" for i in range(60)) >= 57
    assert all(caught[60 + i] == "" for i in range(len(plain)))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    assert clean[60] == f"see {plain[0]} é {plain[0]}" and sum(clean[i] == "see [SECRET] é [SECRET]" for i in range(60)) >= 57


def test_op4_models_alone_decide(spark):
    """Random strings of one case, short ones, and ones within paths are found; paths and identifiers are left alone. The
    parts are those of a plain version. The models are trained from as many labelled documents as in production."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    ratios = secrets.train(secrets.labelled_samples(docs, labels))
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"
    made = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    keys = [made(letters, 26) for _ in range(20)] + [made(letters.upper(), 26) for _ in range(20)] + [made(mixed, 16) for _ in range(20)]
    keys += [f"/the/thonention/entherer/station/{made(mixed, 24)}" for _ in range(20)] + [f"/the/{made(mixed, 30)}/station/thonention/{made(mixed, 30)}/the" for _ in range(20)]
    clean = ["/the/thonention/entherer/station/and/thandethe", "the_thonention_and_the_station", "thandethethonention"]
    docs = documents(spark, list(enumerate([f"see {k} there" for k in keys + clean])))
    got = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.find_secrets(docs, ratios)).collect()}
    rows = [got[i] != "" for i in range(len(keys))]
    found = [sum(rows[i : i + 20]) for i in range(0, 80, 20)] + [sum(got[i].count("markov") == 2 for i in range(80, 100))]
    assert min(found) >= 18, found
    assert [got[len(keys) + i] for i in range(len(clean))] == ["", "", ""]
    for i, k in enumerate(keys + clean):
        want = [f"markov:{4 + a}:{4 + b}" for a, b in random_parts(k, ratios, secrets.ALPHABET, 24.0, 2.0)]
        assert got[i].split(",") == (want or [""])


def test_op4_other_columns(spark):
    rows = spark.createDataFrame([(1, "token=abcdefghij", "a", "b", 3)], "doc_id long, text string, base string, spans string, `row` int")
    out = secrets.redact(secrets.find_secrets(rows, [0.0] * 67**2))
    assert out.columns == rows.columns and tuple(out.first()) == (1, "[SECRET]", "a", "b", 3)


def test_op4_redaction_of_meeting_spans(spark):
    rows = [(1, 'a token = "' + "0f" * 20 + '" AKIA' + "1" * 30 + "abc" * 12 + " z"), (2, None), (3, "clean")]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.find_secrets(documents(spark, rows), [0.0] * 67**2)).collect()}
    assert out == {1: 'a [SECRET]" [SECRET] z', 2: None, 3: "clean"}


def test_op5(spark, small):
    rng = random.Random(11)
    made = []
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 120, 400)))] for _ in range(12)]
    for i, b in enumerate(base):
        made.append((1000 + 100 * i, " ".join(b)))
        for j in range(6):
            c = list(b)
            for _ in range(rng.randrange(1, 1 + len(c) // 20)):
                p = rng.randrange(len(c))
                c[p : p + rng.randrange(2)] = [f"v{rng.randrange(5000)}"] * rng.randrange(2)
            made.append((1001 + 100 * i + j, " ".join(c)))
        made.append((1050 + 100 * i, " ".join(b[len(b) // 2 :] + b[: len(b) // 2])))
    for rows in (odd_rows() + made, small):
        got = near_dups.near_duplicates(documents(spark, rows)).collect()
        assert len(got) == len(rows)
        parent = {d: d for d, _ in rows if d is not None}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        known = [(d, t or "") for d, t in rows if d is not None]
        for i, (d, t) in enumerate(known):
            for e, u in known[:i]:
                if t == u or abs(len(t) - len(u)) <= 0.6 * max(len(t), len(u)) and alignment(t, u) >= 0.8:
                    a, b = sorted((root(d), root(e)))
                    parent[b] = a
        assert {(r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None} == {(d, root(d)) for d in parent}


def test_op5_group_of_strangers_in_one_band(spark):
    """Many texts that share a passage, near copies between some of them."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(80):
        own = [f"o{i}_{j}" for j in range(12)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:-1]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(documents(spark, rows)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(80)) or len(set(got.values())) == 1
    assert rng


def classes_by_brute_force(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if t == u or alignment(t, u) >= 0.8:
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in parent}


def test_op5_order_decides():
    """Four blocks in reversed order share nearly all shingles, and aren't near; a band as wide as the threshold allows."""
    rng = np.random.default_rng(6)
    a = rng.permutation(1 << 20)[:400].astype(np.uint64)
    b = np.concatenate(np.split(a, 4)[::-1])
    run, shared = near_dups.aligned(a, b, 0.8)
    assert run <= 100 and shared.all()
    gone = np.delete(a, rng.choice(400, 80, replace=False))  # 320 of 400
    assert near_dups.aligned(a, gone, 0.8)[0] == 320 >= near_dups.needed(400, 320, 0.8)


def test_op5_candidates():
    """Aligned pairs at the threshold agree in some band."""
    from mosaiq.llm._common import mix

    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        a = mix(rng.integers(0, 1 << 62, 180).astype(np.uint64))
        b = a.copy()
        b[rng.choice(180, 20, replace=False)] = mix(rng.integers(0, 1 << 62, 20).astype(np.uint64))  # 160 of 200 shared
        keys = near_dups.band_keys(np.concatenate([a, b]), np.array([0, 180, 360]), 24)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


@pytest.mark.parametrize("small", [2, 64])
def test_op5_large_group_of_copies(spark, small):
    """Copies of one text that are near to it or not, copies of such copies, cut ones, and the blocks of it moved: with
    leaders alone and with small groups compared pairwise, the classes are those of all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(90)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return w

    texts = [base] + [edited(base, rng.randrange(1, 6)) for _ in range(70)]
    for _ in range(8):
        child = edited(base, rng.randrange(3, 7))
        texts += [child, edited(child, 1), edited(child, 1)]
    texts += [base[: rng.randrange(45, 90)] for _ in range(12)] + [base[rng.randrange(1, 30) :] for _ in range(8)]
    for _ in range(4):
        cut = rng.randrange(20, 70)
        moved = base[cut:] + base[:cut]
        texts += [moved, edited(moved, 1), edited(moved, 2)]
    rows = list(enumerate(dict.fromkeys(" ".join(t) for t in texts)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(documents(spark, rows), small=small).collect()}
    assert got == classes_by_brute_force(rows)


def test_word_hashes():
    """Words of one multiset of letters, and Thue-Morse words, which any power of an odd base modulo 2**64 confuses."""
    from mosaiq.llm._common import Words

    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    made = ["ab", "ba", "abc", "acb", "a" * 70 + "b", "b" + "a" * 70, morse, morse.translate(str.maketrans("ab", "ba")), "AB"]
    raw = " ".join(made).encode()
    bounds = np.array([0, len(raw)])
    h = Words(np.frombuffer(raw, dtype=np.uint8), bounds).hash
    assert len(set(h.tolist())) == len(made)
    assert Words(np.frombuffer(raw, dtype=np.uint8), bounds, lower=True).hash[-1] == h[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op5_prefixes_lose_no_pair(spark, seed):
    """Of random cells, every pair that can reach the bound by what it has of the leader and shares besides is kept."""
    rng = random.Random(seed)
    texts = {}
    for family in range(12):
        base, near = rng.sample(range(1, 400), 40), rng.choice([0, 3, 10, 40, 90, 170])
        for _ in range(8):
            swap = rng.choice([0, 1, 2, 3, 5, 9, 25])
            novel = set(rng.sample(base, 40 - swap)) | {1000 + rng.randrange(1 << 30) for _ in range(swap)}
            have = near + rng.choice([0, 0, 1, 5])
            texts[len(texts)] = (have, novel, rng.random() < 0.8)
    rows = [(7, key, t, have + len(novel), have, active, t) for t, (have, novel, active) in texts.items() for key in novel | {0}]
    cells = spark.createDataFrame(rows, "cell long, key long, node long, n long, have long, active boolean, comp long")
    kept = near_dups._open_groups(near_dups._prefixes(near_dups._open_groups(cells), 0.8))
    got = {(r["a"], r["b"]) for r in near_dups._pairwise(kept, 0.8).collect()}
    must = set()
    for a, (have_a, novel_a, active_a) in texts.items():
        for b, (have_b, novel_b, active_b) in texts.items():
            need = 0.8 / 1.8 * (have_a + len(novel_a) + have_b + len(novel_b)) - 1e-9
            if a < b and (active_a or active_b) and min(have_a, have_b) + len(novel_a & novel_b) >= need:
                must.add((a, b))
    assert len(must) > 20 and must <= got
    assert kept.count() < len(rows)


def test_op5_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 50), (7, 7)]
    got = {tuple(r) for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 41)} | {(50, 50), (100, 50), (101, 50)}


def test_op6(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 90_000), (6, "u", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (7, "u", "x"), (7, "u", "x"), (None, "u", "n"), (8, "u", "é" * 90_000)], "page_id long, url string, html string")
    warc.write_archives(pages.withColumn("payload", pages.page_id), str(tmp_path / "a"), segment_bytes=1000, records_per_file=7)
    got = {(r["page_id"], bytes(r["payload"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = set()
    top = {"x": 7, "": 4, "é" * 90_000: 8}
    for p, h in ((1, "x"), (2, "x"), (3, ""), (4, ""), (5, "é" * 90_000), (6, "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (7, "x"), (None, "n"), (8, "é" * 90_000)):
        to = top.get(h) if top.get(h) != p else None
        want.add((p, b"" if to else h.encode(), len(h.encode()), digest(h), "revisit" if to else "response", to))
    assert got == want


def test_op6_repeated_rows_of_several_segments(spark, tmp_path):
    from collections import Counter as Count

    rows = [(7, "u", "é" * 9000)] * 3 + [(5, "u", "é" * 9000)] * 2 + [(7, "u", "è" * 9000), (7, "v", "y"), (None, "u", "z" * 9000), (None, "u", "z" * 9000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), segment_bytes=1000)
    got = Count((r["page_id"], bytes(r["payload"]).decode(), r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    assert got == {(7, "é" * 9000, "response", None): 3, (5, "", "revisit", 7): 2, (7, "è" * 9000, "response", None): 1, (7, "y", "response", None): 1, (None, "z" * 9000, "response", None): 2}
    heads = [f for p in (tmp_path / "a").glob("part-*") for f, _ in warc.parse(zlib.decompress(p.read_bytes(), 47))]
    ids = [f["warc-record-id"] for f in heads]
    assert len(ids) == len(set(ids)) and {f["warc-refers-to"] for f in heads if "warc-refers-to" in f} <= set(ids)


def test_op6_files_of_other_writers(spark, tmp_path):
    """A gzip member for each record, as usual in such files, and a plain file."""
    import gzip

    made = [b"".join(b + b"\r\n\r\n" for b in warc.records(i, "0", "u", b"p%d" % i * 900, None, 1000)) for i in range(5)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, made[:4])))
    (tmp_path / "a" / "y.warc").write_bytes(made[4])
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {i: b"p%d" % i * 900 for i in range(5)}
    with pytest.raises(ValueError):
        warc.unzipped(gzip.compress(made[0])[:-9])


def test_op6_empty_and_clashing_columns(spark, tmp_path):
    schema = "page_id long, url string, html string, payload string, _sha string, serial int, refers_to string"
    for name, rows in (("none", []), ("one", [(1, "u", "x", "q", "r", 1, "s")])):
        warc.write_archives(spark.createDataFrame(rows, schema), str(tmp_path / name))
        got = warc.read_archives(spark, str(tmp_path / name)).collect()
        assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(1, b"x")] * len(rows)


def test_op6_faults(spark, tmp_path):
    body = b"".join(b + b"\r\n" for b in warc.records(1, "s", "u", b"x" * 5000, None, 1000))
    assert warc.dechunked(b"3;q\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse(body[:-400]))
    parts = list(warc.parse(body))
    assert [f.get("warc-segment-number") for f, _ in parts] == ["1", "2", "3", "4", "5", "6"]


def test_op8(spark, small):
    from tokenizers import Tokenizer

    path = queries._tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for rows in (odd_rows(), small):
        got = packing.pack(packing.token_pieces(documents(spark, rows), path)).collect()
        want = Counter()
        for d, x in rows:
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4")
            cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
            want.update((d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 1024


def best_fit_decreasing(lengths, capacity=1024):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        n += i == len(gaps)
        gap = capacity if i == len(gaps) else gaps.pop(i)
        bisect.insort(gaps, gap - x)
    return n


def test_op8_plan_uses_exact_complements():
    counts = {700: 5, 324: 5, 600: 3, 300: 3, 124: 3, 500: 2, 400: 2, 100: 2, 24: 2, 1024: 4}
    plan = packing.plan_bins(counts, 1024)
    used = Counter()
    for pattern, n in plan:
        for x in pattern:
            used[x] += n
    assert used == Counter(counts) and sum(n for _, n in plan) == sum(k * n for k, n in counts.items()) // 1024
    rng = random.Random(4)
    for _ in range(20):
        counts = Counter(rng.randint(1, 1024) for _ in range(3000))
        plan = packing.plan_bins(counts, 1024)
        used = Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 1024
            for x in pattern:
                used[x] += n
        assert used == counts and sum(n for _, n in plan) <= best_fit_decreasing(list(counts.elements()))


def test_op9(spark, small):
    for rows in (odd_rows(), small):
        got = rows_of(substring_dedup.remove_repeated(documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(op9(rows), key=repr)


def test_op9_periodic_texts(spark):
    """Paths of periodic texts are cut into pieces; passages that begin elsewhere in the period still meet."""
    rng = random.Random(9)
    rows = [(1, "a b c " * 400), (2, "z " + "b c a " * 300), (3, "b " * 700), (4, "q " + "b " * 260), (5, "a b c " * 100 + "b " * 300)]
    rows += [(10 + i, " ".join(rng.choice("xy") for _ in range(600))) for i in range(4)]
    got = rows_of(substring_dedup.remove_repeated(documents(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(op9(rows), key=repr)
    assert any(g[2] for g in got)


def test_op9_words_of_both_places_decide(spark):
    """Equal hashes aren't enough: where the digest of the earliest place is another, nothing is removed."""
    from pyspark.sql import functions as F

    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, "z " + " ".join(f"w{i}" for i in range(40)))]
    found = substring_dedup.repeated(documents(spark, rows))
    assert found.count() > 0
    real, gone = substring_dedup.repeated, {}
    for name, table in (("true", found), ("false", found.withColumn("digest", F.col("digest") + 1))):
        substring_dedup.repeated = lambda *_, table=table: table
        try:
            gone[name] = [r["n_removed"] for r in substring_dedup.remove_repeated(documents(spark, rows)).orderBy("doc_id").collect()]
        finally:
            substring_dedup.repeated = real
    assert gone == {"true": [0, 40], "false": [0, 0]}


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from mosaiq.llm._common import shared_dir

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://h:7077", "hdfs://x")) == "hdfs://x"
    assert shared_dir(session("local[4]", None)) == shared_dir(session("local", None))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))


def test_op10(spark, small):
    """Every byte is given by the six before it, also across words: against explicit nodes, over whole texts."""
    rows = odd_rows() + [(1000 + i, t) for i, t in small[:25]] + [(30, "\x03"), (31, "b a"), (32, "a b")]
    got = rows_of(ctw.score(documents(spark, rows), head=400, head_words=30), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    model = Ctw(6)
    for d, t in rows:
        if not fold(d):
            model.learn(t)
    model.finish()
    want = sorted(((*b, model.log10(t)) for b, (_, t) in zip(op10_base(rows), rows, strict=True)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-8)
    by = {g[0]: g for g in got}
    assert by[31][5] == pytest.approx(by[32][5]) and by[31][6] != pytest.approx(by[32][6], rel=1e-4)  # the order of words counts


def test_op10_look_up():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    table = ctw.Lookup(key, np.arange(len(key)) * 0.5)
    assert np.array_equal(table.get(key), np.where(key != 0, np.arange(len(key)) * 0.5, np.nan), equal_nan=True)
    assert np.isnan(table.get(np.array([0, 1 << 63, 12345], dtype=np.uint64))).all()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.count_tokens(none, queries._tokenizer("word_bpe_49k.json")).count() == 0
    assert packing.pack(packing.token_pieces(none, queries._tokenizer("byte_bpe_50k.json"))).count() == 0
    assert quality_rules.quality_rules(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert secrets.report(secrets.find_secrets(none, secrets.train(spark.createDataFrame([], "value string, is_secret boolean")))).count() == 0
    assert near_dups.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeated(none).count() == 0
    assert ctw.score(none).count() == 0


def test_op6_sql(spark, tmp_path):
    """The SQL agrees where pages have copies, null and empty payloads, other scripts, segments and null ids."""
    html = {1: "a", 2: "a", 3: None, 4: "", 5: "\u4e16\u754c \U0001f600\r\n0\r\n\r\n", 6: "x" * 200_000, 7: "x" * 200_000, 8: "only", 9: "a", None: "a"}
    spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in html.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op6_warc(spark, str(tmp_path))
    names = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op6_warc"])
    assert sorted(want.columns) == names
    rows = want.project(", ".join(names)).fetchall()
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(rows, key=repr)
    assert sum("revisit" in r for r in rows) == 5
