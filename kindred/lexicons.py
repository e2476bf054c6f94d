"""Word lists used by the cue, actor and richness operators.

Every operator takes its lexicon as an argument; these are the defaults.
"""

# Results are only comparable when these lists are equal.

KEPT_TAGS = ("VERB", "NOUN", "ADJ", "ADV", "ADP", "PRON")

BODY_PARTS = (
    "hand", "hands", "arm", "arms", "leg", "legs", "foot", "feet", "knee", "knees",
    "hip", "hips", "head", "shoulder", "shoulders", "elbow", "elbows", "torso", "waist", "back",
)

DIRECTION_WORDS = (
    "left", "right", "forward", "backward", "back", "up", "down", "clockwise", "counterclockwise",
)

SPEED_WORDS = ("slow", "slowly", "quick", "quickly", "fast", "rapid", "rapidly")

ACTOR_NOUNS = {
    "male": ("man", "men", "guy", "boy", "male"),
    "female": ("woman", "women", "girl", "lady", "female"),
    "neutral": (
        "person", "people", "somebody", "someone", "human", "child", "kid", "adult", "dancer",
        "walker", "runner", "athlete", "subject", "actor", "individual",
    ),
}

PRONOUNS = {
    "male": ("he", "him", "his"),
    "female": ("she", "her", "hers"),
    "neutral": ("they", "them", "their", "theirs"),
}

CONNECTIVES = ("and", "then", "while", "before", "after")

THRESHOLDS = (10.0, 0.60, 0.70, 0.75, 0.80, 0.85)

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)

SPLIT_FILES = ("all.txt", "train.txt", "val.txt", "test.txt", "train_val.txt")
