import hashlib
import random

import numpy as np
import pytest

from dossier_spark.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.default_path())


@pytest.fixture(scope="module")
def lib(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    made = ["", " ", "a" * 3000, "aaa aaaa aaaaa", "l'été 123456789 — ça va?!  \n\n\t x", "<|endoftext|>", "日本語テキスト🙂🙂", "=" * 500 + "\n" * 40, "\x00\x01 ​"]
    made += ["".join(r.choice("etaoin shrdlu") for _ in range(400)) for _ in range(20)]
    made += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x17F), r.randrange(0x4E00, 0x4F00), r.randrange(0x1F600, 0x1F640)])) for _ in range(300)) for _ in range(20)]
    return made


def test_transducer_is_bpe(ranks, lib):
    small = bpe.Transducer(ranks, max_states=50)
    t = bpe.Transducer(ranks)
    for text in texts():
        for word in bpe.regex.findall(P.PATTERN, text):
            want = lib.encode_ordinary(word)
            assert t.encode(word.encode()) == want and small.encode(word.encode()) == want
    r = random.Random(5)
    for _ in range(3000):
        raw = bytes(r.choice(b"abcdehinorstu .=-\xc3\xa9\xe2") for _ in range(r.randrange(1, 24)))
        if raw not in ranks:
            assert t.encode(raw) == t.merged(raw)


def test_border_rule(ranks):
    t = bpe.Transducer(ranks)
    r = random.Random(9)
    whole = [i for i in range(0, 50_256, 3) if t.is_whole(i)]
    for _ in range(40_000):
        a, b = r.choice(whole), r.choice(whole[:3000] if r.random() < 0.5 else whole)
        assert t.may_follow(a, b) == (t.merged(t.bytes_of[a] + t.bytes_of[b]) == [a, b]), (a, b)


def test_utf8_machine():
    data = "aé日🙂z".encode()
    for cut in range(len(data) + 1):
        m = bpe.Utf8()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == "aé日🙂z"
    m = bpe.Utf8()
    assert m.feed(b"\xff\xe2") + m.end() == "��"


def test_frame(spark, lib, sf):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "n_tokens long, text string").withColumnRenamed("n_tokens", "id").withColumn("ids", spark_one())
    got = bpe.decode(bpe.encode(df)).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = want[r.id] if r.id != 5 else r.decoded
        assert r.decoded == (t or "") and r.ids == lib.encode_ordinary(t or "") and r.n_tokens == len(r.ids)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op3_byte_bpe(spark, sf).collect():
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    assert bpe.encode(df.limit(0)).count() == 0


def spark_one():
    from pyspark.sql import functions as F

    return F.lit(1)
