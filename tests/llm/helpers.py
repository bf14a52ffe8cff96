import random

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, given to further columns of the input.
CLASH = ("spans", "score", "key", "row_", "shard", "n", "node", "kept", "own_", "ws", "text_")


def documents(spark, rows, clash=True):
    """(doc_id, text) rows as a documents table with further, clashing columns."""
    names = CLASH if clash else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in names)
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *("x" for _ in names)) for i, t in rows], schema)


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
