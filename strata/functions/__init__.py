from strata.functions.flags import ACTIVE_WORDS, ATTENDED_WORDS, truthy
from strata.functions.dates import cutoff, week_start

__all__ = ["ACTIVE_WORDS", "ATTENDED_WORDS", "truthy", "cutoff", "week_start"]
