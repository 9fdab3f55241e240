"""Column expressions (JVM side, whole-stage codegen friendly)."""

from postlytics.functions.timefeat import (epoch_seconds, floor_div, weekday, hour_of_day,
                                          epoch_hour, weekday_one_hot)
from postlytics.functions.binning import cut
from postlytics.functions.text import (WHITESPACE_CLASS, tokens, char_length, length_bucket,
                                      flag_pattern, keyword_matches, keyword_flag,
                                      keyword_counted, clean_title_text, concat_text)
from postlytics.functions.urls import regex_escape, domain_pattern, url_domain_keyword

__all__ = [
    "epoch_seconds", "floor_div", "weekday", "hour_of_day", "epoch_hour", "weekday_one_hot",
    "cut", "WHITESPACE_CLASS", "tokens", "char_length", "length_bucket", "flag_pattern",
    "keyword_matches", "keyword_flag", "keyword_counted", "clean_title_text", "concat_text",
    "regex_escape", "domain_pattern", "url_domain_keyword",
]
