"""Settings from text, and working files."""

import os

import pytest

from mnemoria.config import Settings, from_toml
from mnemoria.operators.capacity import Policy
from mnemoria.operators.consolidate import Compress, Promote


def test_settings_from_toml():
    got = from_toml('[store]\nshards = 33\npolicy = "LRU"\n[decay]\nrate = 0.5\n[[rules]]\ntype = "promote"\nmin_occurrences = 2\n[[rules]]\ntype = "compress"\nsummary_strategy = "dedupe"\n')
    assert got.shards == 64 and got.policy is Policy.LRU and got.decay.rate == 0.5 and got.decay.floor == 0.01
    assert got.rules == (Promote(min_occurrences=2), Compress(summary_strategy="dedupe"))
    assert from_toml("") == Settings()


@pytest.mark.parametrize("text", ["[stores]\nx = 1", "[store]\nshard = 1", "[decay]\nlambda = 1", '[[rules]]\ntype = "drop"', "[store]\ncapacity_per_shard = 0", '[store]\npolicy = "fifo"'])
def test_wrong_settings_are_refused(text):
    with pytest.raises(ValueError):
        from_toml(text)


def test_stream_figures(spark, tmp_path):
    from mnemoria.streaming.metrics import Progress

    progress = Progress()
    spark.streams.addListener(progress)
    spark.range(5).write.parquet(f"{tmp_path}/in")
    query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.queryName("figures").format("memory").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    import time

    for _ in range(50):
        if progress.figures.get("figures", {}).get("rows"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.figures["figures"]["rows"] == 5


def test_working_files(spark, tmp_path):
    from mnemoria.session import discard, is_local, materialize, work_dir

    assert is_local("local") and is_local("local[8]") and not is_local("local-cluster[2,1,1024]") and not is_local("spark://host:7077") and not is_local("yarn")
    kept = materialize(spark.range(5), "test")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1].replace("///", "/")
    assert kept.count() == 5 and work_dir(spark).split(":", 1)[-1].replace("///", "/") in folder and os.path.isdir(folder)
    other = f"{tmp_path}/mnemoria/other"
    spark.range(3).write.parquet(other)
    discard(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 3
    discard(kept)
    assert not os.path.exists(folder)
