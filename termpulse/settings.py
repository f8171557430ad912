"""Fixed values and defaults shared by the whole package."""

from __future__ import annotations

# --- fixed values: limits and thresholds ------------------------------------
TOP_N = 20
MIN_WORD_LENGTH = 2
POSITIVE_THRESHOLD = 0.6
NEGATIVE_THRESHOLD = 0.4
NEUTRAL_RAW = 0.5
NEUTRAL_SCORE = 5.5
SAMPLES_PER_WORD = 50
SAMPLES_PER_WORD_DAY = 20
SAMPLE_SEED = 42
CONTEXT_SAMPLES = 10
KEYWORDS_K = 10
BAR_WORDS = 15
TREND_WORDS = 5
CLOUD_WORDS = 100
BAND_POSITIVE = 6.5
BAND_NEGATIVE = 4.5
NEUTRAL_LINE = 5.5

# --- fixed values: tags and label tables -------------------------------------
LABELLED_SOURCE = "微博-疫情"
CUSTOM_SOURCE = "自定义数据"
UNKNOWN_DATE = "unknown"
EMOTION_LABELS = {
    "happy": 1,
    "neutral": -1,
    "angry": 0,
    "sad": 0,
    "fear": 0,
    "surprise": -1,
}
SENTIMENT_TITLES = {"positive": "正面", "negative": "负面", "neutral": "中性"}

# --- fixed values: accepted input column names, first present wins ------------
CONTENT_NAMES = ("content", "text", "review", "comment", "内容", "文本", "评论")
DATE_NAMES = ("date", "time", "datetime", "created_at", "日期", "时间")

# --- fixed values: field texts a CSV reader takes for "missing" ---------------
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: the built-in sentiment lexicon -----------------------------
POSITIVE_TERMS = (
    "好", "棒", "赞", "喜欢", "开心", "快乐", "优秀", "完美",
    "感谢", "推荐", "满意", "精彩", "厉害", "漂亮", "美丽",
)
NEGATIVE_TERMS = (
    "差", "烂", "坏", "讨厌", "失望", "难过", "垃圾", "糟糕",
    "恶心", "愤怒", "无聊", "可怕", "糟", "骗", "假",
)

# --- fixed values: headers of the exported files ------------------------------
REPORT_HEADERS = ("排名", "热词", "词频", "情感评分", "情感倾向", "正面比例", "负面比例")
TREND_HEADERS = ("日期", "情感评分")

# --- limits of this package's own plans --------------------------------------
# Word lists up to this size travel inside the plan (a literal or a scalar
# subquery); longer ones go through an equi-join on character n-grams.
INLINE_WORDS = 500
# A lookup table is broadcast only after it has been measured below both.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Most frequent words resolved by a broadcast when the full table is too big.
HOT_WORDS = 1_000
# Spark's own limit for cutting groups before the shuffle.
GROUP_LIMIT = 1_000
# Copies of each term when a big term table meets skewed n-grams, and slices
# of a group ranked beyond GROUP_LIMIT.
SALTS = 16
