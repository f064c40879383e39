"""What a Python worker still holds when a task of the token stage is over: the next stage runs in the same worker."""

import public_tokenizers
import pyarrow as pa

from sparquill.llm.triebpe import TrieEncoder, encode_decode


def test_worker_forgets_texts_of_a_task(spark):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"word{i} other{i * 7} and more {i % 5}") for i in range(400)], "doc_id long, text string").repartition(8)
    first = encode_decode(docs, tokenizer).orderBy("doc_id").collect()

    def held(batches):
        for batch in batches:
            made = TrieEncoder._made.values()
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.words) + len(x.pieces) + len(x.fits) for x in made)] * batch.num_rows, pa.int64()), pa.array([len(made)] * batch.num_rows, pa.int64())], ["n", "made"])

    rows = spark.range(64).repartition(16).mapInArrow(held, "n long, made long").collect()
    assert any(r["made"] for r in rows)  # at least one worker is one of those before
    assert max(r["n"] for r in rows) <= 1  # the word of a zero byte
    assert encode_decode(docs, tokenizer).orderBy("doc_id").collect() == first
