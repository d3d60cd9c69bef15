import os
import threading

from dossier_spark.llm import common as C


def there(table):
    return os.path.isdir(table.scratch_path.removeprefix("file://"))


def test_threads_do_not_delete_each_others_tables(spark):
    made, inside, leave = {}, threading.Event(), threading.Event()

    def other():
        with C.Scratch():
            made["other"] = C.written(spark.range(3).toDF("a"), "other")
            inside.set()
            leave.wait(60)
            made["rows"] = made["other"].count()

    t = threading.Thread(target=other)
    with C.Scratch() as scratch:
        kept, gone = scratch.keep(C.written(spark.range(2).toDF("a"), "kept")), C.written(spark.range(1).toDF("a"), "gone")
        t.start()
        assert inside.wait(60)
    assert there(kept) and not there(gone) and there(made["other"])
    leave.set()
    t.join()
    assert made["rows"] == 3 and not there(made["other"])


def test_kept_tables_pass_to_the_scratch_around(spark):
    with C.Scratch() as outer:
        with C.Scratch() as inner:
            a, b = inner.keep(C.written(spark.range(1).toDF("a"), "a")), inner.keep(C.written(spark.range(1).toDF("a"), "b"))
        outer.keep(b)
    assert there(b) and not there(a)
