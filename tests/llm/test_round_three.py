"""What the third round of findings asked for."""

import numpy as np
import public_tokenizers

from chatterlens.llm import planes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_are_opened_once(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(60)], "doc_id long, text string")
    planes.write(docs, str(tmp_path / "set"), VOCABULARY, block_ids=100)
    read = planes.documents(spark, str(tmp_path / "set"))
    read.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert read.count() == 60


def test_planes_of_wide_and_narrow_ids():
    rng = np.random.default_rng(5)
    for high in (2, 300, 2**17, 2**32 - 1):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            for bits in (True, False):
                assert (planes.from_planes(planes.to_planes(ids, bits), n) == ids).all()
