"""A clause is read from its beginning, however long it is."""

from canopyspark.llm import toxicity


def test_report_far_before_an_insult():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    reported, aimed = (toxicity.KINDS.index(k) for k in ("insult_reported", "aimed"))
    filler = "word " * 200
    assert lexicon.emissions(f"he said {filler}idiot")[reported] == 3.0
    assert lexicon.emissions(f"you {filler}idiot")[aimed] == 3.0
    assert lexicon.emissions(f"he said. {filler}idiot")[reported] == 0
