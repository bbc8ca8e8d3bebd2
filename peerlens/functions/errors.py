"""Dial outcomes: error codes, delay classes, directions."""

from pyspark.sql import functions as F

from peerlens import domains as D


def classify_dial_error(message):
    """Error code of a raw message; no message means success."""
    hits = [F.when(message.contains(fragment), F.lit(code)) for code, fragment in D.ERROR_FRAGMENTS]
    return F.when(message.isNull(), F.lit(D.NO_ERROR)).otherwise(
        F.coalesce(*hits, F.lit(D.UNKNOWN))
    )


def delay_class(code, classes=D.DELAY_CLASS_ERRORS, default=D.HOPE):
    """Delay class of an error code (case-sensitive)."""
    pairs = [F.lit(part) for name, errors in classes for e in errors for part in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def direction_name(direction):
    hits = [F.when(direction == number, F.lit(name)) for number, name in D.DIRECTIONS.items()]
    return F.coalesce(*hits, F.lit(D.DIRECTION_UNSET))
