"""Retry policy: which error belongs to which delay class, and its delays."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.functions.errors import delay_class


@dataclass(frozen=True)
class RetryPolicy:
    """A replaceable strategy; every part becomes a Column expression.

    `classes` maps class to error codes, `base_seconds` class to first delay;
    delays of the `growing` classes double with every repetition up to
    `max_seconds`; a peer without a success for `deprecate_after` seconds is
    given up.
    """

    classes: tuple = tuple((name, tuple(codes)) for name, codes in D.DELAY_CLASS_ERRORS)
    default_class: str = D.HOPE
    positive_class: str = D.POSITIVE
    base_seconds: dict = field(default_factory=lambda: dict(D.BASE_DELAY_SECONDS))
    growing: tuple = (D.TIMEOUT,)
    max_seconds: int = D.MAX_DELAY_SECONDS
    deprecate_after: int = D.DEPRECATION_SECONDS

    @property
    def class_names(self):
        return list(dict.fromkeys([name for name, _ in self.classes] + [self.default_class]))

    def class_of(self, error):
        return delay_class(error, [(n, list(c)) for n, c in self.classes], self.default_class)

    def delay(self, name, degree):
        """Seconds until the next attempt of a class at a degree (repetitions, from 1)."""
        base = F.coalesce(
            *[F.when(name == n, F.lit(s)) for n, s in self.base_seconds.items()], F.lit(0)
        )
        # 2^30 times any positive base is beyond the cap, so larger powers change nothing.
        factor = F.pow(F.lit(2.0), F.least(degree - 1, F.lit(30)))
        grown = F.least(base * factor, F.lit(float(self.max_seconds))).cast("long")
        flat = F.least(base, F.lit(self.max_seconds)).cast("long")
        return F.when(name.isin(list(self.growing)), grown).otherwise(flat)

    def seconds(self, name, degree):
        """`delay` of one class and degree, as a plain number for processors that move state row by row."""
        base = self.base_seconds.get(name, 0)
        return int(min(base * 2 ** min(degree - 1, 30) if name in self.growing else base, self.max_seconds))


DEFAULT_POLICY = RetryPolicy()
