"""What an encoder and a segment hold beside their input stays small, and a batch goes through in parts with the same ids."""

import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from leasegrain.llm import token_files
from leasegrain.llm.queries import tokenizer_path

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_batch_is_encoded_in_parts_and_known_pieces_looked_up_by_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "PART", 64)
    monkeypatch.setattr(token_files, "LOOKUP", 16)
    library, encoder = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path(), known=500)
    texts = [f"w{k} and w{k % 7} odd  {k}" if k % 5 == 0 else f"w{k % 40} more, w{k}\nx" for k in range(90)] + ["", None, "a" * 300, " a"]
    for batch in (texts, texts[::-1], texts[:1], [None]):
        found = list(encoder.parts(pa.array(batch, pa.string()), 7))
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in batch]
        assert [n for lengths, _ in found for n in lengths.tolist()] == [len(x) for x in want]
        assert [i for _, ids in found for i in ids.tolist()] == [i for x in want for i in x]
        assert len(found) > 20 or len(batch) < 9
    assert len(encoder.known) == len(encoder.known.unique()) > 16


def test_packing_a_segment_takes_less_than_twice_its_ids():
    ids = np.random.default_rng(1).integers(0, 3000, 4 << 20).astype(np.uint32)
    tracemalloc.start()
    data = token_files.pack_segment([1], np.array([len(ids)]), ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (token_files.Segment(data).ids() == ids).all()
    assert peak < 2 * ids.nbytes


def test_stages_hand_small_batches_to_python(spark):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "64m")
        docs = spark.createDataFrame([(1, "some text here", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[3:4]:
            stage(spark, docs, "unused")
            assert spark.conf.get(KEY) == corpus_pipeline.BATCH
    finally:
        spark.conf.set(KEY, before)
