"""What the package asks of a session."""

from bitgrove import session


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    key, before = session._BATCH_KEY, spark.conf.get(session._BATCH_KEY)
    try:
        spark.conf.unset(key)
        session.ready(spark)
        assert spark.conf.get(key) == str(session.BATCH_BYTES)
        spark.conf.set(key, str(32 << 20))
        session.ready(spark)
        assert spark.conf.get(key) == str(32 << 20)
    finally:
        spark.conf.set(key, before)
