from lithic.streaming import arrivals
from tests.test_images import sample


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, versions in ((6, (96, 99)), (9, (98,))):
        for v in versions:
            (tmp_path / "in" / f"{v}.bin").write_bytes(sample(v))
        arrivals.keep(arrivals.arriving(spark, str(tmp_path / "in"), "functions"), target, state).awaitTermination()
        assert spark.read.parquet(target).count() == n
