"""Registered model queries run the operators at their defaults."""

import pytest

from registry import models as R

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.fixture
def caught(spark, monkeypatch):
    """Params and training rows that a query reaches ``fit_model`` with."""

    def of(query):
        def fit(train, features, target, name, params=None, task=None, seed=42, context=None, order_by=None, series=None):
            raise Called(R.H.default_params(name) | (params or {}), R.H.default_params(name), train.select(target).distinct().count())

        monkeypatch.setattr(R.H, "fit_model", fit)
        with pytest.raises(Called) as e:
            query(spark, SF)
        return e.value.args

    return of


@pytest.mark.parametrize("query", [R.h5, R.h6, R.h7, R.h8, R.h9])
def test_defaults(caught, query):
    got, default, _ = caught(query)
    assert got == default


def test_multiclass(caught):
    got, default, classes = caught(R.h6_doc)
    assert got == default and classes == 4


def test_search(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(R.I, "fit_model", lambda train, features, target, name, params, *a, **k: tried.append(name) or 1 / 0)
    R.i1(spark, SF)
    assert tried.count("LinearModel") == tried.count("RandomForest") == 20
