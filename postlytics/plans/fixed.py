"""Fixed values.

These values must equal those of the studied analysis for the results to be the
same: bin breaks and labels, flag patterns, the weekday shift, the window sizes.
They are stated here once, in their natural order.
"""

# --- Fixed values: time features -------------------------------------------
WEEKDAY_SHIFT_SECONDS = 32400          # weekday is computed 9 h behind UTC
FRONT_PAGE_ROWS = 30                   # posts on the newest page
REPEAT_HORIZONS_HOURS = [12, 48]       # look-back of the repeat-url counts
BUZZWORD_COUNT = 90                    # most frequent title words kept

# --- Fixed values: bins (right-closed) ---------------------------------------
POSTS_PER_AUTHOR_BREAKS = [0, 5, 10, 15, 20, 25, 30]
POSTS_PER_AUTHOR_LABELS = ["<0", "a 0-5", "b 5-10", "c 10-15", "d 15-20", "e 20-25",
                           "f 25-30", "g 30+"]
KARMA_BREAKS = [0, 50, 100, 500, 1000, 5000, 10000, 100000]
KARMA_LABELS = ["<0", "a 0-50", "b 50-100", "c 100-500", "d 500-1000", "e 1000-5000",
                "f 5000-10000", "g 10000-100000", "h 100000+"]
POST_COUNT_BREAKS = [0, 5, 10, 50, 100, 500, 1000, 50000, 100000]
POST_COUNT_LABELS = ["a 0-", "b 0-5", "c 5-10", "d 10-50", "e 50-100", "f 100-500",
                     "g 500-1000", "h 1000-50000", "i 50000-100000", "j 100000+"]
SCORE_CLASS_BREAKS = [2, 4]
SCORE_CLASS_LABELS = ["low", "medium", "high"]
LENGTH_BUCKET_LIMITS = [50, 200]       # > 200 chars -> 3, > 50 -> 2, else 1

# --- Fixed values: substring flag patterns (case-insensitive) ----------------
TITLE_FLAG_PATTERNS = {
    "contains_politician": "trump|selensky|milei|trudeau",
    "contains_programming_language":
        "javascript|typescript|rust|kotlin|java|swift|python|go|scala|lisp|ruby|lua|elm",
    "contains_musk": "elon|musk",
    "contains_brand": "apple|google|microsoft|tesla|nvidia|netflix|ibm|facebook|twitter|amazon|"
                      "oracle|intel|salesforce|slack|paypal|airbnb",
    "contains_vc": "seqouia|tiger global|softbank|andreessen horowitz|index ventures|"
                   "khosla ventures|accel|kleiner perkins|general catalyst",
}
URL_FLAG_PATTERNS = {
    "contains_classical_news": "cnn|bbc|newyorker|guardian|theatlantic|nbcnews|nytimes|reuters|"
                               "cbsnews|washingtonpost|politico|huffpost|abcnews",
    "contains_startupy_news": "vice|verge|businessinsider|arstechnica|wired|forbes|techcrunch",
    "contains_blogname": "medium|substack|blogspot|wordpress",
    "contains_academic": "arxiv|pdf|stanford|columbia|mit.edu|yale|harvard",
    "contains_techcompany": "openai|microsoft|apple|nvidia|google|aphabet|tesla|anthropic|paypal|"
                            "ibm|intel|amazon|uber|lyft|meta",
}

# --- Forest search space (n_estimators, max_depth, min_samples_split,
#     min_samples_leaf, max_features) ------------------------------------------
FOREST_GRID = {
    "n_estimators": [100, 400, 900],
    "max_depth": [10, 15, 20, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [2, 8, 10],
    "max_features": ["sqrt", "log2"],
}

# --- Fixed values: English stop words (the NLTK English list, 179 words) -----
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
