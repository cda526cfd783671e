"""Every query of the timelines against its SQL."""

import pytest

from oracle import same
from tidewave.plans import queries as q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, name):
    assert name in q.ORACLES
    same(q.QUERIES[name](spark, FOLDER), q.ORACLES[name], FOLDER)


def test_flagship_has_rows(spark):
    assert q.flagship(spark, FOLDER).count() > 0


def test_rescale_returns_every_slice(spark):
    n = q.spectral.stft_power(q.views.waveforms(spark, FOLDER), q.FFT16).count()
    assert q.scale_rescale_slices(spark, FOLDER).select("id", "p").distinct().count() == n == 9 * q.views.waveforms(spark, FOLDER).count()
