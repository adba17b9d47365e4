"""A worker keeps the tables of one operator only."""

import public_tokenizers
import pyarrow as pa

from plumbline.llm import bpe, jaccard, langid, shingles

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Captured:
    """Stands for a table: keeps the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):  # noqa: N802
        return function


def test_an_operator_forgets_what_another_one_kept(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some words of a text"])], ["doc_id", "text"])
    encode = bpe.encode_documents(Captured(), PATH, public_tokenizers.PATTERN)
    list(encode(iter([batch])))
    assert bpe.encoder.cache_info().currsize == 1
    list(jaccard._summaries(iter([batch])))
    assert bpe.encoder.cache_info().currsize == 0 and len(shingles._words) > 0
    list(langid.identify(Captured(), None)(iter([batch])))
    assert len(shingles._words) == 0
    first = list(encode(iter([batch])))
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    assert list(encode(iter([batch]))) == first and bpe.encoder(PATH, public_tokenizers.PATTERN) is own
