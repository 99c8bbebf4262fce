"""Written tables between stages."""

from __future__ import annotations

from milldam.llm import store


def test_a_grown_heap_is_collected(spark, monkeypatch):
    """The driver's garbage goes after a written table once its heap is larger than HEAP."""
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(store, "HEAP", 0)
    before, scratch = full(), store.Scratch(spark, "heap")
    assert scratch.save(spark.range(3), "few").count() == 3
    assert full() > before
