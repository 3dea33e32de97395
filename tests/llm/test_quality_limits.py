"""The limits of the quality query against the labels."""

from filigree.llm import queries

SF = "/root/testdata/sf0.01"


def test_limits_turn_repeated_words_away(spark):
    """Of rows labelled 0, mostly a few words repeated, hardly any is kept; of rows labelled 1 hardly any goes."""
    found = {r["doc_id"]: r["keep"] for r in queries.op6_quality_perplexity(spark, SF).collect()}
    labels = queries.table(spark, SF, "labels").collect()
    good = [found[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [found[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05
