from holdlens.llm.near_duplicates import keep_one_of_each, near_duplicates


def test_texts_with_null_ids_are_compared(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda at: " ".join(f"v{i}" if i in at else w for i, w in enumerate(base))
    rows = [(1, near({5, 25, 45, 65})), (None, " ".join(base)), (2, near({10, 30, 50, 70})), (None, "p q r s t u v w x y " * 3), (3, "nothing like the others at all")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("2", "1"), ("3", "3"), ("None", "1"), ("None", "None")]


def test_columns_may_have_any_name_and_ties_are_settled(spark):
    rows = [(1, "a text of six words here", 5, "x", 7), (1, "a text of six words here", 6, "y", 8), (2, "a text of six words here", 1, "z", 9), (None, None, 3, "w", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_key` int, id string, place int")
    first, again = (keep_one_of_each(df.orderBy(order)) for order in ("_key", "id"))
    assert first.columns == df.columns
    got = sorted(first.collect(), key=str)
    assert got == sorted(again.collect(), key=str) and len(got) == 2 and {tuple(r) for r in got} <= set(rows)


def test_a_star_of_many_copies_near_the_threshold(spark):
    """Copies of one text with 5 to 13 of 150 words changed, by words that others use as well, against brute force."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(400):
        t = list(base)
        for at in rng.sample(range(150), rng.randint(3, 13)):
            t[at] = f"v{rng.randrange(12)}"
        texts.append(t)
    sets = [{(t[i], t[i + 1]) for i in range(149)} for t in texts]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, shingle=2).collect()}
    assert got == {i: root(i) for i in range(400)} and 3 < len(set(got.values())) < 390
