"""Every operator against a brute-force version, on small tables with every oddity."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sparkloom.llm import common, ctw, decontaminate, langid, near_copies, packing, pii, queries, simhash, substring_dedup, topk_search, toxicity, url_filter

OPS = {re.match(r"op(\d+)", name)[1]: name for name in queries.QUERIES}


def rows(df) -> list:
    return df.collect()


def run(spark, folder, n) -> list:
    return rows(queries.QUERIES[OPS[str(n)]](spark, folder))


def documents(folder) -> list:
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{folder}/documents.parquet'").fetchall()


def lower(t) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t) -> list:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- all operators ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert rows(queries.QUERIES[name](spark, empty)) == []


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 9])
def test_one_row_per_document(spark, odd, n):
    got = Counter(r["doc_id"] for r in run(spark, odd, n))
    assert got == Counter(d for d, _, _ in documents(odd))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, odd, sf, name):
    for folder in (odd, sf):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        if name.startswith("op10") and folder == odd:  # DuckDB has no wider integers for 1e30, nor zips of unequal lists
            con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM (SELECT * FROM '" + folder + "/embeddings.parquet') WHERE vec_id IS NULL OR vec_id NOT IN (900, 901, 800)")
            continue
        want = con.sql(queries.ORACLE_SQL[name])
        df = queries.QUERIES[name](spark, folder)
        assert sorted(df.columns) == sorted(want.columns)
        order = sorted(df.columns)
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted((tuple(r[c] for c in order) for r in rows(df)), key=key) == sorted((tuple(r) for r in want.project(", ".join(order)).fetchall()), key=key)


# -- 1: personal data --------------------------------------------------------------------------


def brute_spans(t) -> list:
    t = t or ""

    def luhn(d):
        return sum((lambda n: n - 9 if n > 9 else n)(int(c) * (1 + i % 2)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b@c.com x@c.com@d.org", "a..b@-.-", "1.2.3.4.5.6.7.8 01.002.3.255 1.2.3.256 1.2.3", "+1((((2 +12345678 +1.2-3 4(5)6 7 8 9", "4111-1111 1111-1111 5 4111  1111", "é@x.y " + "9" * 40 + "@a.b", "+" * 30 + "1" * 16, "@" * 20, "1.1.1.1" * 5, "x@y.z" * 10, "123-456-7890 +0 12 (34) 56-78."]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_random():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("1234567890..@+- ()aZ%_é4111") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii(spark, odd):
    got = {r.doc_id: r for r in run(spark, odd, 1)}
    for doc, text, _ in documents(odd):
        if doc in (None, 208, 209):
            continue
        base, r = brute_spans(text), got[doc]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        assert all(0 <= s < e <= len(text) for _, s, e in spans)


def test_method_adds_disguised_spans(spark):
    model = pii.fit(common.table(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text"))
    for text, kind in (("call me at (333) 555-8558 today", "phone"), ("my ip 10[.]20[.]30[.]40 is up", "ip"), ("card 4111.1111.1111.1111 ok", "card")):
        assert [k for k, _, _ in pii.spans_of(text, model)[1]] == [kind], text
    for text in ("version 4.0.2 of 2024-05-17", "at noon. Then we left", "page 12 of 999", "chapter 10.20", "it cost $1,234.56"):
        assert pii.spans_of(text, model) == ([], []), text


def loose_documents(seed: int, n: int) -> tuple[list[str], list[list]]:
    """Prose with personal data in looser formats, and where it stands."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = "we met them near the old bridge and then it rained until late so nobody called again".split()
    out, where = [], []
    for _ in range(n):
        text, spans = "", []
        for kind in rng.sample(pii.KINDS, 2):
            text += " ".join(rng.sample(words, 6)) + " "
            base = {"email": f"{rng.choice(words)}.{d(2)}@{rng.choice(words)}.{rng.choice(['com', 'org', 'net'])}", "ip": ".".join(str(rng.randrange(1, 256)) for _ in range(4)), "phone": f"+1 {rng.randrange(200, 999)} {d(3)} {d(4)}"}
            card = d(15)
            base["card"] = card + next(c for c in "0123456789" if pii.luhn(card + c))
            form = rng.choice(pii.disguises(kind, base[kind], rng))
            spans.append((kind, len(text), len(text) + len(form)))
            text += form + " "
        out.append(text + " ".join(rng.sample(words, 5)))
        where.append(spans)
    return out, where


def test_recall_of_added_spans(spark):
    model = pii.fit(common.table(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text"))
    found, all_of = Counter(), Counter()
    for text, spans in zip(*loose_documents(7, 500), strict=True):
        base, more = pii.spans_of(text, model)
        for kind, s, e in spans:
            all_of[kind] += 1
            found[kind] += any(a < e and b > s for _, a, b in base + more)
    shares = {k: found[k] / all_of[k] for k in pii.KINDS}
    print("recall of loose formats", shares)
    assert min(shares.values()) > 0.9, shares


def test_long_lists_of_contacts_take_their_time_in_proportion():
    import time

    def seconds(n: int) -> float:
        text = " ".join(f"u{i}@mail{i}.org ({i % 900 + 100}) 555-{i % 9000 + 1000}" for i in range(n))
        began = time.perf_counter()
        pii.added(text, pii.base_spans(text), (Constant(), np.zeros(4)))
        return time.perf_counter() - began

    class Constant:
        def predict(self, x):
            return np.ones(len(x))

    assert seconds(20_000) < 20 * max(seconds(4_000), 0.05)


def test_clear_ranges_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        taken = [("ip", s, s + rng.randrange(1, 9)) for s in (rng.randrange(100) for _ in range(rng.randrange(12)))]
        clear = pii.Clear(taken)
        for _ in range(20):
            s = rng.randrange(100)
            e = s + rng.randrange(1, 9)
            assert clear.of(s, e) == all(e <= a or s >= b for _, a, b in taken)
            if clear.of(s, e):
                clear.add(s, e)
                taken.append(("ip", s, e))


def test_the_gate_lets_every_generator_through():
    for text in ("Jane (At) Example.com", "jane {AT} site {DOT} com", "jane At site Dot com", "jane\nat\nsite.com", "a [aT] b.org"):
        assert pii.LOOSE["email"].search(text) and pii.suspicious(text), text


def test_redaction(spark, odd):
    got = {r.doc_id: r for r in rows(pii.redact(common.table(spark, odd, "documents", "doc_id", "text", "lang", "source", "n_chars")))}
    assert got[210].text.startswith("Mail [EMAIL] or call [PHONE], card [CARD], host [IP]") and got[210].n_chars == len(got[210].text)
    assert got[200].text is None and got[0].text == documents(odd)[0][1]


# -- 2: url rules --------------------------------------------------------------------------------


def test_url_filter(spark, odd):
    got = run(spark, odd, 2)
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    for r, (page, url) in zip(sorted(got, key=str), sorted(duckdb.sql(f"SELECT page_id, url FROM '{odd}/pages.parquet'").fetchall(), key=str), strict=True):
        del r, page, url
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for page, url in duckdb.sql(f"SELECT page_id, url FROM '{odd}/pages.parquet'").fetchall():
        host, path = "", ""
        if m := re.search(r"://([^/?#]*)([^?#]*)", url or ""):
            host, path = lower(m[1]), m[2]
        fit = next(((h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)
        glob = any(re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g), host + path, re.S) for g in url_filter.GLOBS)
        want = (host, path, fit[0] if fit else None, fit[1] if fit else "block" if glob else "allow")
        assert want in [(r.host, r.path, r.rule, r.verdict) for r in by[page]]


def test_automaton_against_regex():
    import random

    rng = random.Random(1)
    globs = ["".join(rng.choice("ab/*?") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts = ["".join(rng.choice("ab/\u00e9\U0001f600") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    import pyarrow as pa

    got = url_filter.Automaton([url_filter.glob_tokens(g) for g in globs]).run(*common.flat(pa.array(texts)))
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(re.fullmatch("".join({"*": ".*", "?": "."}.get(c, c) for c in g), t)), (t, g)


# -- 3: repeated windows -----------------------------------------------------------------------------


def brute_kept(docs) -> list:
    least: dict = {}
    for d, t, _ in docs:
        w = split(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t, _ in docs:
        w = split(t)
        gone = set()
        for i in range(len(w) - 12):
            first = least.get(tuple(w[i : i + 13]))
            if first is not None and (d is None or first < d):
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("settled", [1 << 10, 6 << 20])
def test_substring_dedup(spark, odd, settled, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SETTLED", settled)
    monkeypatch.setattr(common, "CHUNK", settled)
    got = sorted(map(tuple, run(spark, odd, 3)), key=str)
    assert got == sorted(brute_kept(documents(odd)), key=str)
    assert sum(r[2] for r in got) > 500


def test_rows_that_share_an_id_all_lose_what_an_earlier_document_holds(spark):
    """Different texts without an id, and of one id, in one chunk; the document they copy from in another."""
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(30))
    early = [(1, passage, "en")]
    late = [(d, f"{d} {i} a b c {passage} tail{i}", "en") for i in range(4) for d in (None, 7)]
    schema = "doc_id long, text string, lang string"
    table = spark.createDataFrame(early, schema).coalesce(1).unionByName(spark.createDataFrame(late, schema).coalesce(1))
    got = sorted(map(tuple, rows(substring_dedup.remove_repeats(table, digest=True))), key=str)
    assert got == sorted(brute_kept(early + late), key=str) and sum(r[2] for r in got) == 8 * 30 + 4 * 5  # those without an id share five words more with document 7


def thue_morse(n: int, ones: str = "ab") -> str:
    return "".join(ones[bin(i).count("1") % 2] for i in range(n))


def test_long_words_and_equal_checksums_are_told_apart(spark):
    """Words that polynomial hashes of 64 bits confuse; texts without an id, and of one id, with one checksum."""
    rng = random.Random(6)
    tail = " ".join(f"t{i}" for i in range(12))
    docs = [(1, f"{thue_morse(1024)} {tail}", "en"), (2, f"{thue_morse(1024, 'ba')} {tail}", "en"), (3, f"{thue_morse(1024)} {tail} {tail}", "en")]
    passage = " ".join(f"p{i}" for i in range(20))
    seen: dict = {}
    for i in range(400_000):
        text = (f"{passage} x{i}" if i % 2 else f"y{i} z z z {passage}") + f" {rng.random()}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text and (other[0] == "p") != (text[0] == "p"):
            docs += [(None, other, "en"), (None, text, "en"), (9, other, "en"), (9, text, "en")]
            break
    docs.append((4, f"q {passage}", "en"))
    assert len(docs) == 8
    got = sorted(map(tuple, rows(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, lang string"), digest=True))), key=str)
    assert got == sorted(brute_kept(docs), key=str)


def test_settled_sends_each_text_that_ties_on_the_id():
    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(13))
    texts = [f"{passage} tail{i}" for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([substring_dedup.LAST] * 4), pa.array([1, 2, 3, 1]), pa.array([*texts, texts[0]])], names=["doc", "crc", "text"])
    sent = defaultdict(int)
    for out in substring_dedup.settled(iter([batch]), 13, 1):
        for kind, blob in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            if kind == 0:
                _, _, crc, pos, count, _ = substring_dedup.unpacked(blob)
                for c, at, n in zip(crc, pos, count, strict=True):
                    sent[int(c)] += int(at <= 0 < at + n)
    assert sent == {1: 1, 2: 1, 3: 1}


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    middle = rng.integers(0, 4, 200).astype(np.uint64)  # few names: many runs
    one = np.concatenate([rng.integers(0, 4, 50).astype(np.uint64), middle, rng.integers(0, 4, 31).astype(np.uint64)])
    two = np.concatenate([rng.integers(0, 4, 77).astype(np.uint64), middle])
    a = substring_dedup.anchors(one, np.zeros(len(one), np.int64), 13)[50 : 50 + 188]
    b = substring_dedup.anchors(two, np.zeros(len(two), np.int64), 13)[77 : 77 + 188]
    assert (a == b).all() and len(np.unique(a)) > 5


# -- 4: toxicity ---------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark, odd):
    got = run(spark, odd, 4)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by = {r.doc_id: r for r in got}
    held = [(by[d].predicted, int("fool" in t)) for d, t, _ in documents(odd) if d is not None and 400 <= d < 460 and by[d].held_out]
    assert held and np.mean([a == b for a, b in held]) >= 0.8


def test_label_model_against_plain_loops():
    """One round of expectation and maximisation, written out."""
    rng = random.Random(5)
    cast = [[rng.choice((-1, 0, 1)) for _ in range(3)] for _ in range(40)]
    gold = [rng.random() < 0.4 for _ in cast]
    post = [toxicity.GIVEN if g else 1 - toxicity.GIVEN for g in gold]
    mean = sum(post) / len(post)
    rate = {}
    for j in range(3):
        for v in (-1, 0, 1):
            rate[j, v] = [0.5 + sum(w for w, row in zip(part, cast, strict=True) if row[j] == v) for part in (post, [1 - p for p in post])]
    total = {j: [sum(rate[j, v][k] for v in (-1, 0, 1)) for k in (0, 1)] for j in range(3)}
    expected = {j: [(rate[j, 1][k] - rate[j, -1][k]) / total[j][k] for k in (0, 1)] for j in range(3)}
    error = [[row[j] - p * expected[j][0] - (1 - p) * expected[j][1] for j in range(3)] for row, p in zip(cast, post, strict=True)]
    size = [math.sqrt(sum(e[j] ** 2 for e in error) / len(error)) + 1e-9 for j in range(3)]
    corr = [[sum(e[i] * e[j] for e in error) / len(error) / size[i] / size[j] for j in range(3)] for i in range(3)]
    weight = [1 / (1 + sum(max(corr[i][j] - (i == j), 0) for j in range(3))) for i in range(3)]
    want = []
    for row, g in zip(cast, gold, strict=True):
        z = math.log(mean / (1 - mean)) + (1 if g else -1) * math.log(toxicity.GIVEN / (1 - toxicity.GIVEN))
        z += sum(weight[j] * (math.log(rate[j, row[j]][0] / total[j][0]) - math.log(rate[j, row[j]][1] / total[j][1])) for j in range(3))
        want.append(1 / (1 + math.exp(-z)))
    got, _, _ = toxicity.label_model(np.array(cast), np.array(gold), rounds=1)
    assert got == pytest.approx(want, rel=1e-6)


def test_toxicity_scores_against_plain_loops(spark, odd):
    """Scores of whole texts by the lexicon and weights, word by word."""
    table = common.table(spark, odd, "documents", "doc_id", "text")
    labels = common.table(spark, odd, "labels", "doc_id", "toxic").selectExpr("doc_id", "cast(toxic AS int) toxic")
    lexicon, toxic, weights = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in rows(toxicity.score_texts(table, labels))}
    for d, t, _ in documents(odd):
        if d in (None, 208, 209):
            continue
        words = re.sub("[\x00-\x60\x7b-\x7f]", " ", lower(t)).split(" ")
        words = [w.encode() for w in words if w]
        here = {x for w in words for x in [w, *(b"^" + w[:n] for n in range(4, 9) if n < len(w))] if x in lexicon}
        hits = sum(any(lexicon.get(x, toxic) < toxic for x in [w, *(b"^" + w[:n] for n in range(4, 9) if n < len(w))]) for w in words)
        letters = sum(map(len, words)) or 1
        t = t or ""
        shapes = [min(1, 2 * toxicity.capitals(t)), min(1, 20 * t.count("!") / letters), min(1, 20 * t.count("?") / letters), math.log1p(hits) / 3, min(1, 50 * hits / (len(words) + 1))]
        z = sum(weights[lexicon[x]] for x in here) + sum(w * s for w, s in zip(weights[len(lexicon) :], shapes, strict=False)) + weights[-1]
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-5), d


def test_capitals_count_wherever_they_stand():
    quiet, loud = "abcd efgh " * 400, "ABCD EFGH " * 100
    values = [toxicity.shape(t, toxicity.words_of(t), 0)[0] for t in (loud + quiet, quiet + loud, quiet[:2000] + loud + quiet[2000:])]
    assert values == pytest.approx([0.4] * 3) and toxicity.shape(loud, toxicity.words_of(loud), 0)[0] == 1
    between = "".join("aB" for _ in range(1024))  # only every fourth place was looked at
    assert toxicity.capitals(between) == 0.5 and toxicity.capitals("ÉÀ éà") == 0.5 and toxicity.capitals("") == 0


def test_toxicity_with_repeated_ids_and_short_texts(spark):
    """One text of each id teaches, short texts are copies only where they are equal, long words count."""
    long = "z" * 70
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    data = [(i % 200, f"you {long} {name(i)}" if i % 200 % 2 else f"fine day {name(i)}") for i in range(1000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    lexicon, toxic, weights = toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), labels)
    assert long.encode() in lexicon and lexicon[long.encode()] < toxic and len(weights) == len(lexicon) + toxicity.SHAPES + 1


def test_toxicity_on_driver_data(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in run(spark, folder, 4)}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    held = [(got[d].score, y) for d, y in labels if got[d].held_out]
    right, wrong = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in right for b in wrong]) > 0.8
    assert np.mean([got[d].predicted for d, y in labels if not y]) < 0.05


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.3
    good = np.where(rng.random(2000) < 0.95, truth, ~truth)
    poor = np.where(rng.random(2000) < 0.55, truth, ~truth)
    cast = np.where(np.column_stack([good, poor, poor]), 1, -1)
    gold = np.where(rng.random(2000) < toxicity.GIVEN, truth, ~truth)
    _, accuracy, corr = toxicity.label_model(cast, gold)
    assert accuracy[0] > 0.9 > 0.6 > accuracy[1] and corr[1, 2] > 0.9 > 0.1 > corr[0, 1]
    many = np.where(np.where(rng.random((2000, 8)) < 0.95, truth[:, None], ~truth[:, None]), 1, -1)
    wrong = np.where(rng.random(2000) < 0.9, truth, ~truth)
    post, _, _ = toxicity.label_model(many, wrong)  # many independent voters overrule a wrong label
    assert ((post > 0.5) == truth).mean() > 0.98 > (wrong == truth).mean()


# -- 5: language model -----------------------------------------------------------------------------------


@functools.cache
def brute_ctw(train: tuple[bytes, ...], texts: tuple[bytes, ...]) -> list[float]:
    depth, tree = ctw.DEPTH, {}
    for s in train:
        s = b"\n" * depth + s + b"\n"
        for q in range(depth, len(s)):
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = s[q] >> k & 1
                    tree.setdefault((s[q - d : q], node), [0, 0])[bit] += 1
                    node = 2 * node + bit
    children, own = defaultdict(float), {}
    for (context, node), (a, b) in sorted(tree.items(), key=lambda x: -len(x[0][0])):
        e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        w, own[context, node] = e, 1.0
        if len(context) < depth:
            w = np.logaddexp(e, children[context, node]) - math.log(2)
            own[context, node] = math.exp(e - w - math.log(2))
        if context:
            children[context[1:], node] += w
    out = []
    for s in texts:
        s, total = b"\n" * depth + s + b"\n", 0.0
        for q in range(depth, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit, one = s[q] >> k & 1, 0.5
                for d in range(depth, -1, -1):
                    key = s[q - d : q], node
                    one = own[key] * (tree[key][1] + 0.5) / (sum(tree[key]) + 1) + (1 - own[key]) * one if key in tree else 0.5
                total += math.log10(one if bit else 1 - one)
                node = 2 * node + bit
        out.append(total)
    return out


@pytest.mark.parametrize("merged", [1, 1024])
def test_ctw(spark, odd, merged, monkeypatch):
    monkeypatch.setattr(ctw, "MERGED", merged)
    monkeypatch.setattr(ctw, "TEXT", 60_000 if merged == 1 else 6 << 20)
    monkeypatch.setattr(ctw, "BLOCK", 5_000 if merged == 1 else 1 << 20)
    docs = [(d, lower(t).encode().split(), zlib.crc32(str(d).encode()) % 7 if d is not None else 0) for d, t, _ in documents(odd)]
    count = Counter()
    for _, w, fold in docs:
        if fold != 2:
            count.update([*w, None])
    total, kinds = sum(count.values()), len(count)
    want = []
    chosen = [i for i, (_, w, _) in enumerate(docs) if sum(map(len, w)) < 700]
    train, texts = tuple(b" ".join(w) for _, w, f in docs if f != 2), tuple(b" ".join(docs[i][1]) for i in chosen)
    model = dict(zip(chosen, brute_ctw(train, texts), strict=True))
    for i, (d, w, fold) in enumerate(docs):
        tokens = [*w, None]
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in tokens)
        want.append((str(d), fold == 2, len(tokens), sum(count[x] > 0 for x in tokens), total, base, model.get(i)))
    got = run(spark, odd, 5)
    for w, r in zip(sorted(want, key=lambda x: (x[0], x[2], x[5])), sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score)), strict=True):
        assert w[:5] == (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        assert r.base_score == pytest.approx(w[5], rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)
        if w[6] is not None:
            assert r.score == pytest.approx(w[6], rel=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.25, 100, 12345.5])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


# -- 6: benchmark passages -----------------------------------------------------------------------------


def benchmark_words(t) -> list:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def benchmark_windows(folder) -> dict:
    windows = defaultdict(set)
    for item, text in duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall():
        w = benchmark_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])] |= {item} - {None}
    return windows


@pytest.mark.parametrize("items", [2, 20_000])
def test_decontamination(spark, odd, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", items)
    windows = benchmark_windows(odd)
    want = []
    for d, t, _ in documents(odd):
        w = benchmark_words(t)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        told = ",".join(sorted(map(str, found)))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(told.encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, run(spark, odd, 6)), key=str) == sorted(want, key=str)
    assert sum(x[5] for x in want) > 4
    clean = decontaminate.clean(common.table(spark, odd, "documents", "doc_id", "text"), common.table(spark, odd, "benchmark", "item_id", "text"))
    assert Counter(r.doc_id for r in rows(clean)) == Counter(x[0] for x in want if not x[5])


# -- 7: languages ----------------------------------------------------------------------------------------


def test_language(spark, odd):
    got = run(spark, odd, 7)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 208, 209)}
    for d, t, _ in documents(odd):
        if d in by:
            assert by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
            if not t or not any(map(str.isalpha, t)):
                assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
            else:
                assert by[d].lang_pred in ("en", "fr") and 0 <= by[d].score <= 1


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in run(spark, folder, 7)}
    held = [(got[d].lang_pred == lang) for d, _, lang in documents(folder) if got[d].held_out]
    assert np.mean(held) > 0.97
    assert np.mean([r.rejected for r in got.values()]) < 0.01


def test_vectors_and_centroids_against_plain_loops():
    """Hashed n-grams counted one by one, and the nearest centroid by the cosine of each."""
    import pyarrow as pa

    texts = ["The  quick, brown f\u00e9e!", "a", "", "xyz xyz 123 xyz", "\u00c9T\u00c9 \u00fcber"]
    rng = np.random.default_rng(1)
    idf = rng.random(langid.DIM) + 0.5
    got = langid.vectors(pa.array(texts), idf)
    for t, v in zip(texts, got, strict=True):
        data = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in t.lower().encode())
        data = re.sub(b" +", b" ", data)
        tally = Counter()
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "big") + (n << 24) & 0xFFFFFFFF
                tally[code * 0x9E3779B1 % 2**32 >> 32 - 11] += 1
        want = np.zeros(langid.DIM)
        for place, n in tally.items():
            want[place] = math.log1p(n) * idf[place]
        want /= math.sqrt((want**2).sum()) or 1
        assert v == pytest.approx(want, abs=1e-6)
    samples = {lang: (langid.unit(rng.random((9, langid.DIM))), np.full(9, 5)) for lang in ("aa", "bb")}
    model = langid.Model(idf, samples)
    langs, scores, _ = model.predict(pa.array(texts))
    for t, lang, score in zip(texts, langs, scores, strict=True):
        v = langid.vectors(pa.array([t]), model.idf)[0]
        cosines = [(sum(a * b for a, b in zip(v, c, strict=True)), -i) for i, c in enumerate(model.centres)]
        best = max(cosines)
        assert (lang, score) == (("und", 0) if not any(map(str.isalpha, t)) else (model.languages[model.of[-best[1]]], pytest.approx(best[0])))


def test_rejection_is_by_distance():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    english = ["".join(rng.choice(["the ", "and ", "ing ", "tion ", "of "]) for _ in range(60)) for _ in range(50)]
    idf = np.ones(langid.DIM)
    texts = pa.array(english)
    model = langid.Model(idf, {"en": (langid.vectors(texts, idf), langid.band(texts))})
    _, _, rejected = model.predict(pa.array([english[0], "zqxj wvkf " * 30, None, "123", "of"]))
    assert rejected.tolist() == [False, True, True, True, False]


def test_languages_without_ids_and_among_copies_are_learned(spark):
    """Ids that are all null, and one text that makes up most of a language."""
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60))
    data = [(None, make("abcde"), "aa") for _ in range(30)] + [(i, make("mnopq"), "bb") for i in range(30)] + [(7, "mno pqm nop", "bb")] * 3000
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {(r.text, r.lang_pred) for r in rows(langid.predictions(table, langid.fit(table, langid.training()), ["text"]))}
    want = {t: lang for _, t, lang in data}
    assert all(lang == want[t] for t, lang in got) and len(got) == 61


def test_foreign_languages_and_junk_are_rejected(spark):
    """A language left out of training, and random letters, go; held-out texts of the others stay."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    folder = "/root/testdata/sf0.01"
    table = common.table(spark, folder, "documents", "doc_id", "text", "lang")
    by = defaultdict(list)
    for d, t, lang in documents(folder):
        if t and lang and len(t) > 100 and zlib.crc32(str(d).encode()) % 3 == 1:
            by[lang].append(t)
    junk = pa.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (500, 2000, 8000) for _ in range(5)])
    for out in by:
        model = langid.fit(table.where(F.col("lang") != out), langid.training())
        assert model.predict(pa.array(by[out]))[2].mean() > 0.9, out
        assert model.predict(junk)[2].all()
        assert model.predict(pa.array([t for lang, v in by.items() if lang != out for t in v]))[2].mean() < 0.03


def test_one_odd_text_leaves_other_languages_their_cutoffs():
    idf = np.ones(langid.DIM)
    rng = np.random.default_rng(2)
    import pyarrow as pa

    words = {"aa": ["the ", "and ", "ing "], "bb": ["der ", "und ", "ung "]}
    texts = {k: ["".join(rng.choice(w) for _ in range(80)) for _ in range(60)] for k, w in words.items()}
    texts["bb"][30] = "qzx jvk " * 40
    model, odd = (langid.Model(idf, {k: (langid.vectors(pa.array(v[:n]), idf), langid.band(pa.array(v[:n]))) for k, v in texts.items()}) for n in (30, 60))
    assert odd.least[0, 8] > 0.8 * model.least[0, 8]
    assert model.least[0, 8] > 0.5


# -- 8: packing ------------------------------------------------------------------------------------------


def test_packing(spark, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, _ in documents(odd):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = run(spark, odd, 8)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_plans_are_tight():
    import random

    rng = random.Random(4)
    for limit in (10, 50, 2048):
        for _ in range(20):
            have = Counter(rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 400)))
            sets = packing.plan(dict(have), limit)
            used = Counter()
            for sizes, times in sets:
                assert sum(sizes) <= limit and times > 0
                for s in sizes:
                    used[s] += times
            assert used == have
            bins, least = sum(t for _, t in sets), max(math.ceil(sum(s * n for s, n in have.items()) / limit), sum(n for s, n in have.items() if 2 * s > limit))
            assert bins <= math.ceil(11 / 9 * least) + 1


def optimum(items: tuple, limit: int) -> int:
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= limit and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    import random

    rng = random.Random(8)
    cases = [(50, (41, 22, 20, 8, 4, 3, 2))]
    for n in range(1500):
        limit = rng.choice([10, 13, 20, 50, 100])
        small = [rng.randrange(1, limit // 5 + 2) for _ in range(rng.randrange(0, 6))] if n % 2 else []  # tails of small ones
        cases.append((limit, tuple(sorted(small + [rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 6 if n % 2 else 10))], reverse=True))))
    for limit, items in cases:
        have = dict(Counter(items))
        fixed = sum(t for _, t in packing.reduce(have, limit))
        rest = tuple(sorted(Counter(have).elements(), reverse=True))
        assert fixed + optimum(rest, limit) == optimum(items, limit), items


def test_encoders_agree():
    from tokenizers import Tokenizer

    encode = packing.public_encoder()
    plain = Tokenizer.from_file(encode.path)
    rng = random.Random(12)
    alphabets = ["abc ABC 019 .,'\"-\n\t", "\u00e9\u00df\u0130\u01c5\u0301 x", "\u4e2d\u6587\u3042 \u0645\u0631 \u0928\u094d", "\U0001f600\u200d\ufe0f\u00a0\u2003\u3000 '", "\x00\x01\x1c\x7f\x85\u2028\ufeff a1", "<|endoftext|> "]
    for n in range(1500):
        letters = "".join(rng.sample(alphabets, 2)) if n % 3 else "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x1F700)])) for _ in range(30))
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


# -- 9: near copies ----------------------------------------------------------------------------------------


def brute_groups(docs) -> list:
    """doc_id, fingerprint and component of (doc_id, text, ...) rows."""
    fps = []
    for _, t, *_ in docs:
        w = split(lower(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, fps[i], min(ids[find(i)], default=None)) for i, (d, *_) in enumerate(docs)]


@pytest.mark.parametrize("longest", [1, 64])
def test_simhash(spark, odd, longest):
    want = sorted(brute_groups(documents(odd)), key=str)
    found = simhash.groups(common.table(spark, odd, "documents", "doc_id", "text"), longest=longest)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows(found)), key=str) == want
    if longest == 64:
        assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in run(spark, odd, 9)), key=str) == want
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in run(spark, odd, 9))


@pytest.mark.parametrize("longest", [2, 64])
def test_links_of_long_posting_lists(spark, longest):
    """One group of near fingerprints in one another's lists, and others that share six bytes but not the distance, against all pairs."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(500)}
    fps |= {base ^ (rng.getrandbits(16) << 48) for _ in range(300)} | {base ^ (rng.getrandbits(8) << 8 | rng.getrandbits(8) << 40) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(200)} | {(base & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(200)}
    fps = sorted(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    close = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    for i, j in close:
        root[find(i)] = find(j)
    want = [find(i) for i in range(len(fps))]
    at = {fp: i for i, fp in enumerate(fps)}
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps]
    got = rows(simhash.links(spark.createDataFrame(signed, "fp long"), longest))
    assert all(want[at[r.u % (1 << 64)]] == want[at[r.v % (1 << 64)]] for r in got)
    root = list(range(len(fps)))
    for r in got:
        root[find(at[r.u % (1 << 64)])] = find(at[r.v % (1 << 64)])
    assert len({find(i) for i in range(len(fps))}) == len(set(want))
    assert len(got) < 36 * len(fps)


def test_components_of_long_chains(spark):
    from sparkloom.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + (i * 37) % 50, 100 + ((i + 1) * 37) % 50) for i in range(49)] + [(500, 499), (501, 500), (500, 501)]
    got = {r.u: r.v for r in rows(components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 150)}, 500: 499, 501: 499}


def test_one_of_each(spark, odd):
    kept = rows(simhash.one_of_each(common.table(spark, odd, "documents", "doc_id", "text", "lang", "source", "n_chars")))
    ids = Counter(r.doc_id for r in kept)
    assert ids[5] == 1 and not any(ids[100 + i] for i in range(12)) and ids[209] == 0 and ids[9] == 1 and ids[None] == 1


def brute_near(docs) -> dict:
    """By doc_id the smallest doc_id linked to it by five-word Jaccard similarities of 0.8 or more."""
    sets = {}
    for d, t in docs:
        w = split(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for k in s or {()}:
            by[k].append(d)
    for a, b in {(a, b) for ds in by.values() for a in ds for b in ds if a < b}:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("block", [2, 1024])
def test_near_copies(spark, block, monkeypatch):
    """Edits of many bits, chains, a large group, texts that share less, short and empty ones."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for n in (1, 2, 3, 4, 6):
            c = list(b)
            for at in rng.sample(range(len(c)), n):
                c[at] = f"x{rng.randrange(10**6)}"
            docs.append((100 + 10 * i + n, " ".join(c)))
    chain = list(base[0])
    for i in range(40):  # each one near the last, the ends far apart
        chain[3 * i] = f"y{i}"
        docs.append((1000 + i, " ".join(chain)))
    docs += [(2000 + i, " ".join([*base[1][:100], f"z{i}"])) for i in range(80)]
    docs += [(3000 + i, " ".join([*base[2][:60], *(f"v{i}.{j}" for j in range(30))])) for i in range(20)]
    docs += [(4000, ""), (4001, None), (4002, "One two"), (4003, "one TWO"), (4004, "one two three four five six")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_near(docs)
    assert {r.doc_id: r.component_id for r in rows(near_copies.groups(table))} == want
    assert len(set(want.values())) < len(docs) // 2
    assert {r.doc_id for r in rows(corpus_pipeline.near_copy_stage(spark, table.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars"), ""))} == set(want.values())


def test_near_copies_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r.component_id for r in rows(near_copies.groups(common.table(spark, folder, "documents", "doc_id", "text")))}
    assert got == brute_near([(d, t) for d, t, _ in documents(folder)])


def test_near_copies_meet_by_fingerprint(spark, monkeypatch):
    """The index alone finds most edited copies and nothing else; what it misses is found without it."""
    rng = random.Random(8)
    docs = []
    for i in range(150):
        b = [f"w{rng.randrange(5000)}" for _ in range(150)]
        docs.append((10 * i, " ".join(b)))
        for n in (1, 2):
            for at in rng.sample(range(150), n):
                b[at] = f"x{rng.randrange(10**6)}"
            docs.append((10 * i + n, " ".join(b)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_near(docs)
    with monkeypatch.context() as only:
        only.setattr(near_copies, "left_apart", lambda documents, nodes, sketches, own, near: near.limit(0))
        got = {r.doc_id: r.component_id for r in rows(near_copies.groups(table))}
    assert all(want[d] == want[c] for d, c in got.items())
    assert len(docs) - len(set(got.values())) >= 0.9 * (len(docs) - len(set(want.values()))) > 0
    monkeypatch.setattr(simhash, "partners", lambda nodes, *_: nodes.selectExpr("fp u", "fp v").limit(0))
    assert {r.doc_id: r.component_id for r in rows(near_copies.groups(table))} == want


@pytest.mark.parametrize("longest", [1, 1024])
def test_partners(spark, longest):
    """The least and the nearest of those that share two positional bytes and differ in twelve bits at most, against all pairs."""
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {fp ^ sum(1 << b for b in rng.sample(range(64), n)) for fp in sorted(fps) for n in (1, 3, 6, 9, 12)}
    signed = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in fps)
    near = defaultdict(list)
    for a in signed:
        for b in signed:
            x = (a ^ b) % (1 << 64)
            if a != b and x.bit_count() <= 12 and x.to_bytes(8).count(0) >= 2:
                near[a].append((x.bit_count(), b))
    got = {(r.u, r.v) for r in rows(simhash.partners(spark.createDataFrame([(fp,) for fp in signed], "fp long"), 6, 12, longest))}
    want = {tuple(sorted((a, b))) for a, found in near.items() for b in (min(found)[1], min(b for _, b in found))}
    assert got == want if longest > 1 else got and all(b in [o for _, o in near[a]] for a, b in got)


# -- 10: search --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 1024])
def test_topk(spark, odd, block, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "PASS", 1 << 20 if block > 1 else 1)
    vectors = []
    for i, e in duckdb.sql(f"SELECT vec_id, embedding FROM '{odd}/embeddings.parquet'").fetchall():
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors.append((i, [math.floor(1024 * x) for x in e]))
    want = []
    for at, (q, e) in enumerate(vectors):
        if q % 100:
            continue
        scored = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, f)))), i) for n, (i, f) in enumerate(vectors) if n != at))[:10]  # noqa: B905
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, run(spark, odd, 10))) == sorted(want)


def test_whole_scores_of_few():
    """Only what can reach the cutoff is added up, and nothing that reaches it is missed."""
    rng = np.random.default_rng(3)
    rows_ = np.floor(300 * rng.standard_normal((600, 64)) * np.geomspace(1, 0.02, 64))
    asked = rows_[:40]
    total = (rows_ @ asked.T).astype(np.int64)
    r, c, score = topk_search.gathered(rows_, asked, 4, 11)
    assert (score == total[r, c]).all() and len(r) < total.size / 10
    least = np.array([np.sort(score[c == j])[-11] for j in range(40)])
    r, c, score = topk_search.survivors(rows_, asked, 4, least)
    assert (score == total[r, c]).all() and len(r) < total.size / 10
    assert set(zip(r.tolist(), c.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(total >= least)), strict=True))


# -- the pipeline --------------------------------------------------------------------------------------------


def test_stages(spark, odd):
    """Each stage on what its predecessor left, against brute force where the stage is not trained."""
    docs = common.table(spark, odd, "documents", *corpus_pipeline.COLUMNS)
    left = [rows(docs)]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            docs = common.stored(out)
            left.append(rows(docs))
    named = [{r.doc_id: r for r in part if r.doc_id is not None} for part in left]
    assert {200, 201, 202, 203}.isdisjoint(named[1]) and set(named[0]) - set(named[1]) <= {200, 201, 202, 203}
    unnamed = 1 << 62  # rows without an id come after all, told apart by their texts
    near = brute_near([((unnamed if r.doc_id is None else r.doc_id, r.text or ""), r.text) for r in left[1]])
    first = {d for (d, _), root in near.items() if d == root[0]} - {unnamed}
    assert set(named[2]) == first and len(left[2]) == len({r.doc_id if r.doc_id is not None else r.text for r in left[2]})
    windows = benchmark_windows(odd)
    sizes = {len(k) for k in windows}

    def leaks(text):
        w = benchmark_words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert left[3] and sorted(map(str, left[3])) == sorted(str(r) for r in left[2] if not leaks(r.text))
    for d, r in named[4].items():
        before = named[3][d]
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not any(c in before.text for c in "0123456789@"):
            assert r == before
    assert "[EMAIL]" in named[4][210].text and {r.doc_id for r in rows(out)} == {r.doc_id for r in left[4]}


def test_run(spark, odd, empty):
    docs = common.table(spark, odd, "documents", *corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, odd))
    assert sorted(map(str, rows(corpus_pipeline.run(spark, odd)))) == sorted(map(str, rows(docs)))
    assert rows(corpus_pipeline.run(spark, empty)) == []
