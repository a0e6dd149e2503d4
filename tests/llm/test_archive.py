"""Dictionaries of archives."""

import random

import zstandard

from corpusloom.llm import warc


def test_dictionary_is_trained_on_all_records():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(2000)]
    records = [warc.record(i, f"http://h/{i}", " ".join(r.choices(words, k=120))) for i in range(400)]
    size = min(warc.DICTIONARY_BYTES, sum(map(len, records)) // 16)
    # accel 1 alone counts every position and takes all samples for the entropy tables.
    assert warc.build_dictionary(records) == zstandard.train_dictionary(size, records, k=512, d=8, f=18, accel=1, level=warc.LEVEL).as_bytes() != b""
