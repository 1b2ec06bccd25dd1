"""The batch build from sources to metrics, on a tiny corpus."""

import numpy as np

from slotloom.operators import encoder
from slotloom.plans import jobs


def test_build(spark, tmp_path):
    root = tmp_path / "corpus"
    for i in range(12):
        folder = root / "ann" / f"repo{i}"
        folder.mkdir(parents=True)
        (folder / "m.py").write_text(
            f"limit: int = {i}\nname: str = 'x'\n\n\ndef add{i}(left: int, right: typing.List[int]) -> int:\n    total: int = left + right[0]\n    return total\n\n\ndef greet{i}(who: str, often: int) -> str:\n    return who * often\n"
        )
    out = str(tmp_path / "out")
    assert jobs.extract_job(spark, f"file://{root}", out).count() == 12 * 9
    points = jobs.preprocess_job(spark, out)
    assert {r.type for r in points.select("type").distinct().collect()} == {"int", "str", "List[int]"}
    params = jobs.PARAMETERS | {"vector_size": 8, "w2v_epochs": 1, "top_n_hints": 4}
    features = jobs.vectorize_job(spark, out, params)
    row = features.first()
    assert np.array(row.identifiers).shape == (31, 8) and np.array(row.tokens).shape == (21, 8) and features.count() == points.count()
    model = encoder.Encoder.random(8, 6, 4, 5)
    jobs.save_encoder(model, str(tmp_path / "weights.npz"))
    again = jobs.load_encoder(str(tmp_path / "weights.npz"))
    assert (again.weight == model.weight).all() and again.variant == model.variant
    predictions = jobs.predict_job(spark, out, again, params, vocabulary_limit=10)
    n_test = points.where("split = 'test'").count()
    assert predictions.count() == n_test
    if n_test:
        report = {r.task: r for r in jobs.eval_job(spark, out).collect()}
        assert report["Combined"].n == n_test and 0 <= report["Combined"].mrr_all <= 100
