from tonearm.operators import settings

RULES = {"floor": ("float", "0.5", ()), "gpu": ("bool", "true", ()), "encoding": ("int", "3", ("0", "1", "2", "3")), "root": ("path", None, ())}
ROWS = "owner long, seq long, key string, value string, fit string"


def test_coerced(spark):
    rows = [
        (1, 1, "floor", "x", "z"), (1, 2, "gpu", "OFF", None), (1, 3, "encoding", "7", None), (1, 4, "root", " ", None), (1, 5, "old", "1", None),
        (2, 1, "floor", "0.1", None), (2, 2, "floor", "0.2", None), (2, 2, "floor", "0.2", None), (2, 1, "gpu", None, None), (None, 1, "root", "/a", None),
    ]
    got = {(r["owner"], r["key"]): (r["value"], r["warning"]) for r in settings.coerced(spark.createDataFrame(rows, ROWS), RULES).collect()}
    assert got == {
        (1, "floor"): ("0.5", "floor was 'x', now the default"), (1, "gpu"): ("false", None), (1, "encoding"): ("3", "encoding was '7', now the default"),
        (1, "root"): (None, "root was ' ', now the default"), (2, "floor"): ("0.2", None), (2, "gpu"): ("true", None), (None, "root"): ("/a", None),
    }
    assert settings.coerced(spark.createDataFrame([], ROWS), RULES).isEmpty()


def test_profiles(spark):
    own = spark.createDataFrame([(1, "floor", "0.5"), (1, "gpu", "true"), (2, "floor", "0.5")], "owner long, key string, value string")
    chosen = spark.createDataFrame([(1, " House ", 1), (1, "FESTIVAL", 2), (2, "none such", 1)], "owner long, profile string, seq long")
    profiles = spark.createDataFrame([("house", "floor", "0.6"), ("house", "gpu", "false"), ("festival", "floor", "0.7"), ("festival", "gpu", None)], "profile string, key string, value string")
    got = sorted(tuple(r) for r in settings.with_profile(own, chosen, profiles).select("owner", "key", "value").collect())
    assert got == [(1, "floor", "0.7"), (1, "gpu", "false"), (2, "floor", "0.5")]
