import numpy as np

from loomway.llm import queries
from loomway.llm.sentences import sentences, words
from loomway.llm.subjects import Model, Scorer, assign, train, training_set

TEXT = """Hi all,
# Title without an end
The tram was late. It stopped at 13:30 … Was it?
```
print("code. code!")
```
| a | b. |
[Net X] Sponsor of the league. Rent a flat!
  # A comment sentence here.
key: 3
> Punkt 3: der Bus kam am 23. Oktober. Danach nicht.
--
Somebody wrote this.

thx!!!"""


def test_sentences():
    got = sentences(TEXT)
    assert [s.split()[0] for s in got] == ["The", "It", "Was", "A", "Punkt", "Danach"]
    assert sentences(None) == sentences("") == sentences("  \n ") == sentences("12 34. 5.") == []
    assert sentences("<p>RÃ©seau.</p><p>La rÃ©union a eu lieu. :-)</p>")[0].startswith("La réunion")
    assert len(sentences("```\nnever closed here.\n")) == 1
    assert words("État des Straßen 12 ÉTÉ") == ["etat", "des", "strassen", "0", "ete"]


def corpus(spark):
    r = np.random.default_rng(0)
    pool = {"sport": ["the coach won the match", "a club lost the final"], "law": ["the court upheld the contract", "this clause annulled the penalty"]}
    docs, labels = [], []
    for i in range(160):
        mine = ["sport", "law"][i % 2]
        n = int(r.integers(4, 9))
        s = [r.choice(pool[mine]) for _ in range(n)] + (["More on this next time"] if i % 3 else [])
        docs.append((i, ". ".join(s) + "."))
        labels.append((i, mine if i % 40 else "law"))
    docs += [(1000, "The coach won the match. The court upheld the contract. A club lost the final."), (1001, None), (1002, ""), (1003, "1 2 3"), (1003, "1 2 3"), (None, "The coach won the match."), (1004, "The coach won the match. " * 6 + "This clause annulled the penalty."), (1005, "The court upheld the contract. " * 4000)]
    labels += [(5000, "law"), (None, "law"), (1, "astronomy"), (2, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as subject"), spark.createDataFrame(labels, "doc_id long, subject string")


def test_train_and_assign(spark):
    docs, labels = corpus(spark)
    names = ["law", "sport"]
    model = train(training_set(docs, labels, names), names, docs_per_partition=50)
    got = {}
    for r in assign(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    right = sum(got.get(i) == [["sport", "law"][i % 2]] for i in range(160))
    assert right >= 0.95 * 160
    assert sorted(got[1000]) == names and got[1004] == ["sport"] and got[1005] == ["law"]
    assert not {1001, 1002, 1003, None} & got.keys()


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark)
    model = train(training_set(docs, labels.limit(0), ["law"]), ["law"], rounds=2)
    assert assign(docs, model).count() == 0
    assert assign(docs.limit(0), model).count() == 0


def test_bound_on_training_documents(spark):
    docs, labels = corpus(spark)
    assert 20 <= training_set(docs, labels, ["law", "sport"], max_docs=50).count() <= 90


def test_scorer_folds_outputs():
    m = Model.start(["a", "b"])
    p = Scorer(m).probabilities(["the tram"])[0]
    assert p.shape == (2,) and (p < 0.35).all()


def test_held_out(spark):
    r = queries.p9_holdout(spark, "/root/testdata/sf0.1").first()
    assert r.precision > 0.9 and r.recall > 0.9
