import json

import pytest
from pyspark.sql import functions as F

from stratavox.plans import control
from stratavox.plans.settings import Settings, setting

DEFAULTS = {"export": {"format": "tif"}, "levels": 3}


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    s = Settings(str(path), DEFAULTS)
    assert s.get("export.format") == "tif" and s.get("export.none.deeper", 5) == 5
    s.set("export.depth", 16)
    s.save()
    assert Settings(str(path), DEFAULTS).get("export.depth") == 16 and DEFAULTS["export"] == {"format": "tif"}
    path.write_text("{broken")
    assert Settings(str(path), DEFAULTS).get("levels") == 3 and (tmp_path / "s.bak").exists()
    (tmp_path / "o.json").write_text(json.dumps({"levels": 1}))
    with pytest.raises(ValueError):
        s.read_from(str(tmp_path / "o.json"))


def test_setting_column(spark):
    assert spark.range(1).select(setting(F.lit(json.dumps(DEFAULTS)), "export.format")).first()[0] == "tif"


def test_timings_counts_and_tags(spark):
    t = control.Timings()
    with t.step("a"), control.cancellable(spark, "tagged"):
        rows, seen = control.counted(spark.range(7))
        rows.collect()
        assert "tagged" in spark.getTags()
    assert seen.get["n"] == 7 and t.frame(spark, "r").count() == 1 and "tagged" not in spark.getTags()
    assert control.cancel(spark, "tagged") == []
