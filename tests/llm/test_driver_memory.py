"""What the driver holds while it learns the toxicity model."""

import tracemalloc

from webloom.llm import toxicity


def test_training_on_few_rows_holds_little():
    words = [[f"w{(7 * i + k) % 90}x" for k in range(12)] + (["foulword"] if i % 2 else []) for i in range(60)]
    tracemalloc.start()
    try:
        model = toxicity.fit_rows(words, [i % 2 for i in range(60)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert "foulword" in model.weights
    assert peak < 40 << 20  # the hashed features' counts and their sums
