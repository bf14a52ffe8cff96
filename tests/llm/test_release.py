import time

from tests.llm.helpers import documents, prose
from wardflow.llm import jaccard, lm
from wardflow.llm.common import release


def shuffle_files(spark):
    """The shuffles whose files the session holds on its own disks."""
    names = (str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    return {n.rsplit("/", 1)[-1].split("_")[1] for n in names if "/shuffle_" in n}


def left(spark, run):
    """Shuffles that ``run`` leaves behind while the frame it builds is still to be run; the last one may be held a while."""
    release(spark)
    time.sleep(1)
    before, frame = shuffle_files(spark), run()
    for _ in range(20):  # Spark drops them in the background
        more = shuffle_files(spark) - before
        if len(more) < 2:
            break
        time.sleep(0.25)
    return more, frame


def rows():
    return [(i, prose(60, i // 2) + (" extra" if i % 2 else "")) for i in range(60)]


def test_jaccard_steps_leave_no_shuffles(spark):
    more, frame = left(spark, lambda: jaccard.join(documents(spark, rows())))
    assert len(more) < 2
    assert {r["component_id"] for r in frame.collect()} == set(range(0, 60, 2))


def test_lm_steps_leave_no_shuffles(spark):
    docs = documents(spark, rows())
    more, frame = left(spark, lambda: lm.score(docs, frequent=20, frequent_pairs=20))
    assert len(more) < 2
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    assert all(abs(r["score"] - whole[r["doc_id"]]) < 1e-6 for r in frame.collect())
