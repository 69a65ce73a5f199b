"""Small tables with every oddity: nulls, empty and very long texts, ties, repeated rows, more columns."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "stone river light under paper green seven cloud window table market north silver garden bridge letter winter copper orange forest".split()
TELL = "dumb awful stupid".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "er"]) for _ in range(n))


def write(folder: str, name: str, columns: dict, schema: pa.Schema) -> None:
    pq.write_table(pa.table(columns, schema=schema), os.path.join(folder, f"{name}.parquet"))


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string()), ("fp", pa.int64()), ("key", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("rejected", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("text", pa.string())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.int32()), ("rule", pa.int32())])
EMBEDDINGS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.string())])


def tables(folder: str, documents: list, labels: list, benchmark: list, pages: list, embeddings: list) -> str:
    os.makedirs(folder, exist_ok=True)
    extra = lambda n: {"score": ["x"] * n, "fp": [7] * n, "key": [1] * n, "rank": [1] * n, "kind": ["k"] * n, "rejected": ["no"] * n}
    write(folder, "documents", {"doc_id": [d[0] for d in documents], "text": [d[1] for d in documents], "lang": [d[2] for d in documents], "source": ["s"] * len(documents), "n_chars": [len(d[1]) if d[1] is not None else None for d in documents], **extra(len(documents))}, DOCUMENTS)
    write(folder, "labels", {"doc_id": [x[0] for x in labels], "quality": [1] * len(labels), "toxic": [x[1] for x in labels], "text": ["t"] * len(labels)}, LABELS)
    write(folder, "benchmark", {"item_id": [x[0] for x in benchmark], "text": [x[1] for x in benchmark], "doc_id": [3] * len(benchmark)}, BENCHMARK)
    write(folder, "pages", {"page_id": [x[0] for x in pages], "url": [x[1] for x in pages], "html": ["h"] * len(pages), "host": [1] * len(pages), "rule": [2] * len(pages)}, PAGES)
    write(folder, "embeddings", {"vec_id": [x[0] for x in embeddings], "embedding": [x[1] for x in embeddings], "label": [0] * len(embeddings), "score": ["x"] * len(embeddings)}, EMBEDDINGS)
    return folder


def odd_documents() -> list:
    rng = random.Random(5)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, rng.randrange(5, 120)) + (" " + passage if i % 6 == 0 else ""), "en" if i % 4 else "fr") for i in range(60)]
    docs = [(i, t.replace("e", "é") if lang == "fr" else t, lang) for i, t, lang in docs]
    docs += [(100 + i, docs[5][1], "en") for i in range(12)]  # exact copies
    docs += [(120 + i, docs[7][1] + f" tail{i}", "en") for i in range(8)]  # near copies
    docs += [(None, "no id here at all", None), (None, docs[5][1], "en"), (200, None, "en"), (201, "", None), (202, " \t\n\r\x0b\x0c ", "en"), (203, "?!. 123 --", "en")]
    docs += [(204, "again and again " * 40, "en"), (205, "word " * 300, "en"), (206, "x" * 300_000, "en"), (207, "<|endoftext|> is ordinary text", "en")]
    docs += [(208, prose(rng, 9000), "en"), (208, docs[3][1], "en"), (209, docs[9][1], "en"), (209, docs[9][1], "en")]  # long; repeated ids and rows
    docs += [(210, "Mail JOE.Doe+x@mail.example.com or call +1 (333) 555-8558, card 4111 1111 1111 1111, host 10.20.30.40.", "en")]
    docs += [(211, "At noon. tel (333) 555-8558 \u00e9\U0001f600 joe@host 999.1.2.3 4111111111111112 version 4.0", "en")]
    docs += [(300 + i, f"Contact u{i}.x@mail{i}.example.org or +44 20 7946 0{i:03} about {prose(rng, 12)} from 10.0.{i}.7 with 4111111111111111", "en") for i in range(40)]
    docs += [(400 + i, prose(rng, 30) + (" you " + rng.choice(TELL) + " fool" if i % 3 == 0 else ""), "en") for i in range(60)]
    return docs


@pytest.fixture(scope="session")
def odd(tmp_path_factory) -> str:
    docs = odd_documents()
    rng = random.Random(9)
    item = " ".join(docs[8][1].split()[2:16])
    benchmark = [(0, item), (1, prose(rng, 30)), (2, "again and"), (3, None), (4, ""), (5, "?!"), (None, docs[10][1]), (0, item), (11, docs[9][1].upper())]
    pages = [(0, "https://www.Example.COM/en/1?q=a/en/"), (1, "http://x.example.com/en/2"), (2, "ftp://a.net/es/"), (3, "https://net/fr/x#y"), (4, None), (5, ""), (6, "no scheme"), (7, "https://example.org"), (None, "https://ads.shop.org/x"), (8, "https://a.org/ads/1.exe"), (8, "https://a.org/ads/1.exe"), (9, "https://a.com"), (10, "https://é.com/" + "p" * 50_000), (11, "https://notexample.com/en/"), (12, "http://a?b://c.com/"), (13, "https://xnet/es/"), (14, "://com/")]
    vectors = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(8)]) for i in range(230)]
    vectors += [(i, [0.5] * 8) for i in range(300, 340)] + [(400, None), (500, [0.1, None] + [0.2] * 6), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [0.5] * 8), (800, []), (900, [1e30] * 8), (901, [1.0, 2.0]), (100, [0.25] * 8)]
    labels = [(d[0], int("fool" in (d[1] or ""))) for d in docs if d[0] is not None and d[0] >= 300] + [(None, 1), (3, None), (400, 0)]
    return tables(str(tmp_path_factory.mktemp("odd")), docs, labels, benchmark, pages, vectors)


@pytest.fixture(scope="session")
def empty(tmp_path_factory) -> str:
    return tables(str(tmp_path_factory.mktemp("empty")), [], [], [], [], [])
