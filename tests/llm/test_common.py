from tessera.llm.common import Scratch


def test_scratch_names_what_it_holds(spark):
    """Operators drop all tables but their results by name; without it query 8 and the pipeline ended in an error."""
    scratch = Scratch(spark)
    kept = scratch.table(spark.range(3), "kept")
    scratch.table(spark.range(2), "gone")
    assert scratch.names == ["kept", "gone"]
    scratch.drop(*[name for name in scratch.names if name != "kept"])
    assert scratch.names == ["kept"] and kept.count() == 3
