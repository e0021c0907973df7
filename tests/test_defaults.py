"""Queries that train run as long as their operators' defaults say."""

from __future__ import annotations

import inspect

import pytest

from newsloom.operators import corpus as K
from newsloom.operators import trainlog as L
from newsloom.plans import all_queries


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, operator, argument",
    [
        ("m2_train_vectors", K, "train_vectors", "epochs"),
        ("m2_train_vectors", K, "train_vectors", "size"),
        ("s12_save_model", K, "train_vectors", "epochs"),
        ("s12_save_model", K, "train_vectors", "size"),
        ("m4_title_regressor", L, "train_title_regressor", "max_iter"),
    ],
)
def test_training_is_as_long_as_the_default(spark, monkeypatch, name, module, operator, argument):
    signature = inspect.signature(getattr(module, operator))

    def asked(*args, **kwargs):
        given = signature.bind(*args, **kwargs)
        given.apply_defaults()
        raise Asked(given.arguments[argument])

    monkeypatch.setattr(module, operator, asked)
    with pytest.raises(Asked) as got:
        all_queries()[0][name](spark, "/root/testdata/sf0.001")
    assert got.value.args == (signature.parameters[argument].default,)
