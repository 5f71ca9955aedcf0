import hashlib
import random

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import bpe
from orrery.llm.common import DOC_COLUMNS

BAD = ["zorf", "grumk", "blatz"]


def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    docs, labels = [], []
    for i in range(500):
        words = rng.choices(vocabulary, k=rng.randint(40, 90))
        words[0] = words[0].title()
        toxic = i % 8 == 0
        junk = i % 10 == 9
        if toxic:
            for at in range(0, len(words), 12):
                words[at] = rng.choice(BAD)
        text = " ".join(w.upper() + "%%%" if junk else w for w in words) + "."
        docs.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    docs += [(1000 + i, docs[k][1], "en", "copy", 1) for i, k in enumerate((1, 1, 2))]
    changed = docs[3][1].split()
    changed[-1] = "abcdefgh."
    docs.append((1010, " ".join(changed), "en", "copy", 1))
    return docs, labels


def through(spark, now, sf_dir):
    """The documents' ids behind each stage, and the last result."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        now.write.parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
        out[name] = sorted((r["doc_id"] for r in now.collect()), key=str)
    return out, now.collect()


def test_odd_documents(spark, tmp_path):
    docs, labels = rows()
    odd = [(None, docs[5][1], "en", "hot", 1), (2001, None, "en", "hot", 0), (2002, "", None, None, 0), (2003, "two words", None, None, None), (2002, "", None, None, 0), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # Columns of the operators' own names stand beside those of documents.
    df = spark.createDataFrame(docs + odd, schema)
    for name in ("carried", "keep", "id", "key", "ids", "mix_place", "severity", "rank"):
        df = df.withColumn(name, F.lit(name))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    kept, last = through(spark, df, f"{tmp_path}/a")
    strange = sorted((d[0] for d in odd), key=str)
    for name, ids in kept.items():
        assert [i for i in ids if i is None or i > 2000] == strange, name
    none = hashlib.sha256(b"").hexdigest()
    assert {r["decoded_sha256"] for r in last if r["doc_id"] in (2001, 2002)} == {none}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    empty, _ = through(spark, spark.createDataFrame([], schema), f"{tmp_path}/b")
    assert set(map(len, empty.values())) == {0}


def test_stages(spark, tmp_path):
    docs, labels = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "byte_bpe":
            assert now.columns == DOC_COLUMNS
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in now.collect()}
    first = {d[0] for d in docs}
    junk = {i for i, q, _ in labels if not q}
    toxic = {i for i, _, t in labels if t} - junk
    assert not kept["quality_classifier"] & junk and len(first - junk - kept["quality_classifier"]) <= 10
    assert len(kept["toxicity"] & toxic) <= 3 and len(kept["quality_classifier"] - toxic - kept["toxicity"]) <= 8
    assert kept["ngram_jaccard_join"] == kept["toxicity"] - {1000, 1001, 1002, 1010}
    assert kept["mixing_sources"] == kept["ngram_jaccard_join"] == kept["byte_bpe"]
    path, pattern = bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {d[0]: d[1] for d in docs}
    for r in now.collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
