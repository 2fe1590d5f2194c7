from cuelake.llm import language_id
from cuelake.llm.common import with_package_path


def test_every_language_is_learned(spark):
    """More than 200 languages, the rare ones too, and as many rows of each as asked."""
    with_package_path(spark)
    rows = [(i, f"text of number {i}", f"l{i % 230:03}") for i in range(230 * 12)]
    got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = language_id.Model(got, steps=1)
    assert model.names == [f"l{i:03}" for i in range(230)] and len(model.net.params[-1]) == 230
    each = [sum(lang == n for _, lang in got) for n in model.names]
    assert min(each) >= 5 and max(each) <= 13
