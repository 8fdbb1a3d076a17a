from pathlib import Path

import pytest

from lodestrata.session import scratch, shared_dir, stored


def folders(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://"), "lodestrata").glob("scoped-*")}


def test_scratch_deletes_what_was_stored_inside(spark):
    outer = stored(spark.range(3).toDF("x"), "scoped-outer")
    with scratch(spark):
        stored(spark.range(2).toDF("x"), "scoped-one")
        with scratch(spark):
            assert stored(spark.range(5).toDF("x"), "scoped-two").count() == 5
        assert len(folders(spark)) == 2
    assert len(folders(spark)) == 1 and outer.count() == 3
    with pytest.raises(ValueError, match="inside"), scratch(spark):
        stored(spark.range(2).toDF("x"), "scoped-three")
        raise ValueError("inside")
    assert len(folders(spark)) == 1
