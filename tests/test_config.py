import pytest

from gristmill.operators import tables
from gristmill.sources import config, schema


def test_secrets(tmp_path, monkeypatch):
    (tmp_path / "key").write_text("  s3cret \n")
    (tmp_path / "none").write_text(" ")
    monkeypatch.setenv("A_KEY", "from env")
    assert config.secret("literal") == "literal" and config.secret("env:A_KEY") == "from env" and config.secret(f"file:{tmp_path}/key") == "s3cret"
    assert config.secret(str(tmp_path / "key")) == "s3cret" and config.secret(None, ("NOT_SET_HERE", "A_KEY")) == "from env"
    for bad in ("env:NOT_SET_HERE", f"file:{tmp_path}/gone", f"file:{tmp_path}/none"):
        with pytest.raises(config.SecretError):
            config.secret(bad)
    with pytest.raises(config.SecretError):
        config.secret(" ")
    assert len(config.fingerprint("x")) == 8 and "x" not in config.fingerprint("x")


def test_headers_and_boxes(spark):
    from pyspark.sql import functions as F

    assert tables.short_headers(["a\n b", "a b", "x" * 90]) == ["a b", "a b#2", "x" * 80]
    s = schema.Schema.of([{"name": "a", "type": "number"}])
    assert tables.without_open_enums(s) == s
    box = tuple(F.lit(v) for v in (0, 0, 10, 10))
    assert [r[0] for r in spark.createDataFrame([(1, 1, 3, 3), (8, 8, 20, 20)], "a int, b int, c int, d int").select(tables.inside(box, *[F.col(c) for c in "abcd"])).collect()] == [True, False]
