"""The corpus operators against plain versions, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken

from tabulens.llm import bpe, decontam, hilbert, licenses, lm_mix, minhash, ogg, pii, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb").read().splitlines())}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega été über".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    """Nulls, empty and long texts, ties, copies, repeated rows, near copies and odd signs."""
    rng = random.Random(5)
    base = text(rng, 120)
    near = [" ".join(w if i != k * 7 else "changed" for i, w in enumerate(base.split())) for k in range(1, 6)]
    texts = [None, "", " \n\t", base, base, *near, "one", "one two", "it's 're  x\n\n y", "中文 ٣ 😀 a b", "mail bob.x@example.com or +1 (743) 555-3824, card 4111 1111 1111 1111 ip 10.0.0.256 10.0.0.25", text(rng, 6000), "a" * 5000, *(text(rng, 80) for _ in range(12))]
    out = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[7], (None, "no id here at all", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents"
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pre_tokens_are_those_of_the_pattern():
    rng = random.Random(1)
    signs = ["'", "s", "re", "ll", "d", " ", "  ", "\n", "é", "中", "5", "٣", "_", "!", "''", "'S", "Ⅷ", "\x1c", "😀", "\r\n", "'s"]
    for _ in range(4000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert bpe.pre_tokens(t) == [m.group() for m in regex.finditer(public_tokenizers.PATTERN, t)], t


def test_bpe_is_that_of_the_library(docs, empty):
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = Counter((r[0], tuple(ENCODING.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.digests(empty, PATH).collect() == []


def test_hilbert_curve_visits_neighbours():
    table, size = hilbert.curve_states(3)
    places = {}
    for p in range(8**3):
        point, state, place = (p >> 6, p >> 3 & 7, p & 7), 0, 0
        for level in (2, 1, 0):
            found = table[state * size + sum((c >> level & 1) << i for i, c in enumerate(point))]
            state, place = found // size, place * size + found % size
        places[place] = point
    assert len(places) == 512
    assert all(sum(abs(a - b) for a, b in zip(places[i], places[i + 1], strict=True)) == 1 for i in range(511))


def test_shards_are_even_and_gapless(docs, empty):
    got = hilbert.document_shards(docs, 4).collect()
    assert len(got) == len(rows())
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    places = sorted((r["shard"], r["slot"], r["curve"]) for r in got)
    assert [c for _, _, c in places] == sorted(r["curve"] for r in got)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert hilbert.document_shards(empty, 4).collect() == []


def test_ogg_round_trip_and_damage(docs, empty):
    for n in (0, 1, 575, 576, 577, 60_000):
        data = bytes(i % 251 for i in range(n))
        media = ogg.encode(ogg.padded(data), n)
        track = ogg.decode(media)
        assert track.payload == ogg.padded(data) and track.length == n
        for at in (5, len(media) // 2, len(media) - 1):
            with pytest.raises(ogg.OggError):
                ogg.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ogg.OggError):
            ogg.decode(media[:-1])
    long = ogg.Stream(7, [(b"h", 0), (b"x" * 255 * 600, 5), (b"", 6), (b"y" * 255, 7)])
    assert ogg.demux(ogg.mux([long])).packets[7] == [p for p, _ in long.packets]
    slow = 0
    for b in b"123456789":  # the checksum, bit by bit
        slow ^= b << 24
        for _ in range(8):
            slow = (slow << 1 ^ (0x04C11DB7 if slow >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(b"123456789") == slow
    got = ogg.digests(ogg.load(ogg.store(docs))).collect()
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in got) == Counter((r[0], hashlib.sha256(ogg.padded((r[1] or "").encode())).hexdigest()) for r in rows())
    assert ogg.digests(ogg.load(ogg.store(empty))).collect() == []


def edits(a, b):
    """The least distance of a to any passage of b, by the plain recurrence."""
    last = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def test_edit_matching_finds_all_within_the_budget(spark, docs, empty):
    rng = random.Random(2)
    items = {i: decontam.normalise(text(rng, 15)) for i in range(8)}
    matcher = decontam.Matcher(items)
    for _ in range(60):
        i = rng.randrange(8)
        passage = list(items[i])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        t = decontam.normalise(text(rng, 30) + " " + "".join(passage) + " " + text(rng, 30))
        got = {k: d for k, d, _, _ in matcher.find(t)}
        want = {k: d for k, x in items.items() if (d := edits(x, t)) <= matcher.budget[k]}
        assert got == want
    bench = spark.createDataFrame([(1, rows()[3][1][10:200].upper()), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    leaks = decontam.find_leaks(docs, bench).collect()
    assert {r["doc_id"] for r in leaks if r["distance"] == 0} >= {3, 4}
    assert not {3, 4} & {r["doc_id"] for r in decontam.decontaminated(docs, bench).collect()}
    assert decontam.decontaminated(docs, bench.limit(0)).count() == len(rows())
    assert decontam.find_leaks(empty, bench).collect() == []


def test_items_of_one_id_or_none_are_all_searched_for(spark):
    rng = random.Random(13)
    items = [(1, text(rng, 12)), (1, text(rng, 14)), (None, text(rng, 13)), (None, text(rng, 15)), (2, text(rng, 12))]
    df = spark.createDataFrame([(i, f"{text(rng, 20)} {t} {text(rng, 20)}", None, None, None) for i, (_, t) in enumerate(items)] + [(9, "clean words only", None, None, None)], DOCS)
    bench = spark.createDataFrame([*items, (1, items[0][1].upper()), items[2]], "item_id long, text string")
    leaks = [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect() if r["distance"] == 0]
    assert Counter(leaks) == Counter((i, k) for i, (k, _) in enumerate(items))
    assert [r["doc_id"] for r in decontam.decontaminated(df, bench).collect()] == [9]


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is 7 x 8?"), (2, "Paris"), (3, " "), (4, "no such")], "item_id long, text string")
    made = ["Q: what is\n7 x 8? A: 56", "comparison of Parisians", "comparis paris, x", "what is 7 x 9?", "paris"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(made)], DOCS)
    assert sorted(tuple(r) for r in decontam.find_leaks(df, bench).collect()) == [(0, 1, 0, 3, 17), (2, 2, 0, 9, 14), (4, 2, 0, 0, 5)]
    assert sorted(r["doc_id"] for r in decontam.decontaminated(df, bench).collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in decontam.decontaminated(df, bench, shortest=10).collect()) == [1, 2, 3, 4]


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, empty):
    rng = random.Random(3)
    signs = list("0123456789") * 2 + list(".@+- ()abZé_%,\n") + ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+49 30 1234567", "😀", "", "256"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["1" * 20_000, "a.a" * 5000 + "@b.c", None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(made)], DOCS)
    for r in pii.document_spans(df).collect():
        want = base_spans(made[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""} and r["n_card"] == sum(x.startswith("card") for x in want)
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert out[0] is None and out[14].startswith("mail [EMAIL] or [PHONE], card [CARD] ip") and out[3] == rows()[3][1]
    assert not base_spans(out[14]) and pii.document_spans(empty).collect() == []


def test_licenses(spark, docs, empty):
    made = ["Released under the MIT-License.", "GNU  General\nPublic License and Apache License, CC-BY-4.0 cc by", "mitlicense", None, "", "nothing", "x released y under the q mit z license w", "é" * 3 + " mit license"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(made)], DOCS)
    for r in licenses.scan(df).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), made[r["doc_id"]] or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert licenses.scan(empty).collect() == []


def test_licenses_across_lines(spark):
    import textwrap

    made, want = [], []
    for t, label in licenses.TEMPLATES.items():
        for lead in (0, 13, 29, 45, 200):
            words = ["filler"] * lead + t.split() + ["filler"] * 40
            made.append("\n * ".join(textwrap.wrap(" ".join(words), 35)))
            want.append(label)
    made.append("\n".join(f"line {i} of words" for i in range(300)) + "\nredistribution\n" + "x\n" * 80 + "source and binary forms")
    made.append("und mit einer von den anderen hier\nlicensed under the apache license version 2 0")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(made)], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[len(made) - 1]["labels"] == "apache"
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1 for i, label in enumerate(want))
    assert got[len(want)]["labels"] == "" and got[len(want)]["score"] == 0


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(data, like):
    sets = {i: shingles(t, like.words) for i, t in data}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and like.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("like", [minhash.QUERY, minhash.DEFAULT])
def test_near_duplicates(spark, docs, empty, like):
    rng = random.Random(6)
    data = [(r[0], r[1]) for r in rows()[:-2]]
    for g in range(4):  # groups whose members drift away from their first text
        words = text(rng, 150).split()
        for _ in range(12):
            words[rng.randrange(150)] = rng.choice(WORDS)
            data.append((len(data), " ".join(words)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS).union(spark.createDataFrame([(None, "no id here", None, None, None)], DOCS))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, like).collect()}
    want = classes(data, like)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in want} == want
    assert all(got[i]["kept"] == (i == want[i][1]) for i in want) and got[None]["component_id"] is None
    kept = [r["doc_id"] for r in minhash.deduplicated(df, like).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i in want if i == want[i][1]) and kept.count(None) == 1
    assert minhash.near_duplicates(empty, like).collect() == []


def test_components_of_a_path_and_a_star(spark):
    name = lambda i: f"{i:04d}".encode()
    links = [(name(i), name(i + 1)) for i in range(40)] + [(name(100), name(i)) for i in range(101, 160)]
    got = {bytes(r["node"]): bytes(r["comp"]) for r in minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {name(i): name(0) for i in range(41)} | {name(i): name(100) for i in range(100, 160)}


def test_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rng = random.Random(9)
    words = text(rng, 60).split()
    data = []
    for i in range(40):
        words[rng.randrange(60)] = rng.choice(WORDS)
        data.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], DOCS)
    want = classes(data, minhash.QUERY)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, minhash.QUERY).collect()} == {i: c for i, (_, c) in want.items()}


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(7)
    data = []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(["vileword", "nastyterm", "foulthing"]) + rng.choice(["", "ly", "ness"])
        data.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in data] + [(None, None, None, None, None), (900, "", None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.document_scores(docs, labels).collect()}
    held = [(y, got[i]) for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for _, r in held) and sum(r["predicted"] == y for y, r in held) >= 0.95 * len(held)
    assert 0 <= got[900]["score"] < toxicity.THRESHOLD and 0 <= got[None]["score"] <= 1
    assert toxicity.document_scores(docs, labels.limit(0)).filter("score > 0").count() == 0
    assert toxicity.document_scores(empty, labels).collect() == []
    data, starts = toxicity.windows("x" * 1000 + " é b c")
    assert data.count(b"x") == 1000 and starts[0] == 0 and starts[-1] == len(data) and [data[a:b].count(b" ") for a, b in zip(starts, starts[1:], strict=False)] == [toxicity.WINDOW] * (19 // toxicity.WINDOW) + [19 % toxicity.WINDOW] * (19 % toxicity.WINDOW > 0)


def test_toxicity_dictionaries_hold_all_that_is_typical(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    vile, plain = [word() for _ in range(60)], [word() for _ in range(400)]
    data = [(i, " ".join([*rng.choices(plain, k=40), *(rng.sample(vile, 12) if i % 2 else []), *(["zqx"] if i % 2 else [])]), i % 2) for i in range(500)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in data], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int"))
    assert all(f" {w}".encode() in model.toxic and f" {w[:5]}".encode() not in model.ordinary for w in vile)  # 300 beginnings
    assert b" zqx" in model.toxic
    own = next(i for i, (a, b) in enumerate(zip(model.toxic[::-1], model.ordinary[::-1], strict=True)) if a != b)
    assert len(set(model.ordinary[:-own].split())) > 50  # what ordinary texts are likelier to hold, not only filler


def test_language_model(docs, empty):
    got = lm_mix.document_scores(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows() if not held(r[0]) for w in tokens(r[1]))
    n, v = counts.total(), len(counts)
    want = Counter()
    for r in rows():
        t = tokens(r[1])
        want[r[0], held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_mix.document_scores(empty).collect() == []


def test_warc(spark, tmp_path, monkeypatch):
    made = [(i, f"http://h{i % 3}.example.com/{i % 5}?q={i}", ("same" if i % 2 else f"page {i}") if i % 7 else None) for i in range(50)] + [(None, None, "same"), (49, "http://bad[", "same"), (60, "http://x/\r\ny z", "é" * 5000)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    last = {}
    for i, _, h in made:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in made:
        b, top = (h or "").encode(), last[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    df = warc.page_records(pages)
    path = f"file://{tmp_path}/out"
    df.write.parquet(path)
    got = spark.read.parquet(path).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    order = [(r["url_key"], r["captured"]) for r in df.collect()]
    assert order == sorted(order)
    assert warc.page_records(pages.limit(0)).collect() == []
    data = warc.record(1, "http://a", b"x" * 99, None, False)
    for bad in (data[:-3], data[:40] + b"\x00" + data[41:], b"junk" + data):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))
    import zlib as z

    for head in (b"\xff\xfe", b"WARC/1.0\r\nContent-Length: x", b"WARC/1.0\r\nA: b", b""):  # whole members with damaged heads
        pack = z.compressobj(3, z.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.records(pack.compress(head + b"\r\n\r\n") + pack.flush()))
    monkeypatch.setattr(warc, "FEW_SHARED", 0)
    assert Counter((r["page_id"], r["refers_to"]) for r in warc.page_records(pages).collect()) == Counter({(k[0], k[4]): n for k, n in want.items()} if len({(k[0], k[4]) for k in want}) == len(want) else [(k[0], k[4]) for k, n in want.items() for _ in range(n)])


def test_loser_tree_and_runs():
    rng = random.Random(10)
    for _ in range(400):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    made = [(f"k{rng.randint(0, 50)}", "t", rng.choice([None, rng.randint(0, 100)]), "u", 1, "d", "response", None, "a", i) for i in range(3000)]
    assert list(warc.merge_runs(made, 100, 3)) == sorted(made, key=warc._sort_key)
