import public_tokenizers

from sheafspark.functions.register import register
from sheafspark.functions.tokens import Vocabulary


def test_functions_and_source_from_sql(spark, tmp_path):
    (tmp_path / ".hidden").write_text("12")
    bpe = Vocabulary("b", "tiktoken", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    register(spark, {"bpe": bpe})
    row = spark.sql(
        "SELECT transcode(X'FFFE48006900', 'UTF-16LE') AS t, gzip_size_9(repeat('x', 1000)) AS z, n_tokens_bpe('hello world') AS n"
    ).first()
    assert row.t.asDict() == {"text": "Hi", "encoding": "UTF-16LE", "had_replacements": False}
    assert row.z < 100 and row.n == 2
    listed = spark.read.format("corpus").load(str(tmp_path)).first()
    assert (listed.path, listed["size"]) == (".hidden", 2)
