from pyspark import SparkContext

from pagegrain.llm.contamination import contamination


def test_one_block_at_a_time(spark, documents, monkeypatch):
    """A block is released before the next is collected."""
    alive, most, sizes = set(), [], []
    broadcast = SparkContext.broadcast

    def counted(self, value):
        made = broadcast(self, value)
        destroy = made.destroy
        made.destroy = lambda *a, **b: (alive.discard(id(made)), destroy(*a, **b))
        alive.add(id(made))
        most.append(len(alive))
        sizes.append(sum(len(text) for _, text in value))
        return made

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    items = [(k, " ".join(f"item{k}word{n}" for n in range(12))) for k in range(30)]
    texts = [(k, f"before {text} after") for k, text in items] + [(99, "none of them")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(documents(texts), benchmark, block_bytes=1500).select("doc.doc_id", "items").collect()
    assert {r.doc_id: r["items"] for r in found} == {**{k: [str(k)] for k, _ in items}, 99: []}
    assert len(most) > 5 and max(most) == 1 and not alive
    assert max(sizes) < sum(sizes) / 2
