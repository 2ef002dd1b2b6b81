import numpy as np
import pytest
from helpers import blobs, points_df

from lexigrove.operators.kmeans import nearest_center
from lexigrove.operators.minibatch import update_centers
from lexigrove.streaming import load_centers, stream_minibatch
from lexigrove.streaming.minibatch import step

PARTS = 6


def expected(x, start):
    """Centres after each part, one after the other."""
    centers, seen, out = start.copy(), np.zeros(len(start)), []
    for part in np.array_split(np.arange(len(x)), PARTS):
        at, sq = nearest_center(x[part], centers)
        sums = np.zeros((len(centers), 2 + x.shape[1]))
        for row, c, d in zip(x[part], at, sq):
            sums[c] += [1, d, *row]
        centers, seen = update_centers(centers, seen, sums)
        out.append((centers, seen))
    return out


def write(spark, x, folder, parts):
    for i, part in enumerate(np.array_split(np.arange(len(x)), PARTS)):
        if i in parts:
            points_df(spark, x[part]).coalesce(1).write.parquet(f"{folder}/part{i}")


def run(spark, folder, state, start):
    stream = spark.readStream.schema("word_id long, features array<double>").option("maxFilesPerTrigger", 1)
    stream = stream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    query = stream_minibatch(stream, start, state)
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


@pytest.fixture(scope="module")
def data():
    x, _ = blobs(n=90)
    return x, x[:4] + 0.1


def test_stream_equals_the_steps_also_after_a_restart(spark, data, tmp_path):
    x, start = data
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, x, folder, {0, 1, 2})
    run(spark, folder, state, start)
    want = expected(x, start)
    centers, seen, batch = load_centers(spark, state)
    assert np.allclose(centers, want[2][0]) and np.array_equal(seen, want[2][1]) and batch == 2
    write(spark, x, folder, {3, 4, 5})
    run(spark, folder, state, start * 0 + 9)  # the stored centres count, not these
    centers, seen, batch = load_centers(spark, state)
    assert np.allclose(centers, want[5][0]) and np.array_equal(seen, want[5][1]) and batch == 5


def test_replayed_and_empty_batches(spark, data, tmp_path):
    x, start = data
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, x, folder, {0, 1})
    run(spark, folder, state, start)
    before = load_centers(spark, state)
    again = spark.read.parquet(f"{folder}/part1")
    step(again, 1, state)
    assert all(np.array_equal(a, b) for a, b in zip(before, load_centers(spark, state)))
    step(again.limit(0), 2, state)
    centers, seen, batch = load_centers(spark, state)
    assert batch == 2 and np.array_equal(centers, before[0]) and np.array_equal(seen, before[1])
    nulls = spark.createDataFrame([(1, None)], again.schema)
    step(nulls, 3, state)
    assert np.array_equal(load_centers(spark, state)[1], seen)
