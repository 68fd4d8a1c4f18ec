"""Fixed values that define behaviour, in one place."""

# Voice activity.
WINDOW_SAMPLES = 512
SAMPLE_RATE = 16_000
WINDOW_MS = 32
VAD_THRESHOLD = 0.5
MIN_SILENCE_MS = 200
MIN_SPEECH_MS = 250
PAD_MS = 100
MAX_BLOCK_SEC = 28.0

# Omission check.
COVERAGE_SPEECH_SEC = 10.0
MIN_WORDS_PER_SPEECH_SEC = 1.0

# Subtitles.
MAX_CHARS_PER_LINE = 42
MAX_LINES = 2
MIN_CUE_SEC = 1.0
MAX_CUE_SEC = 7.0
READING_CHARS_PER_SEC = 17

# Speakers and diarization error.
SPEAKER_THRESHOLD = 0.475
MIN_EMBED_SEC = 0.6
MAX_SPEAKERS = 8
FRAMES_PER_SEC = 100
MAX_LABELS = 8

# Bench policy and learned speed.
RTF_GOOD, RTF_USABLE = 0.4, 0.8
LOAD_TIMEOUT_SEC = 900
ITEM_TIMEOUT_SEC, ITEM_TIMEOUT_RTF = 60.0, 5.0
LEARNED_SAMPLES, LEARNED_MIN_SPEECH_SEC, LEARNED_MAX_RTF = 5, 30.0, 100.0
CALIBRATION_SEC, CALIBRATION_SHARE = 30.0, 0.9
CHUNK_SEC, STRIDE_SEC, JUMP_SEC = 30.0, 5.0, 20.0
RESERVE_BYTES, RESERVE_SHARE = 150 * 1024 * 1024, 0.1
KEPT_RUNS = 3
QUOTA_TIGHT = 0.8

LONG_FILE_SEC = 1800.0
LANGUAGE_PAIRS = ("es-en", "en-es")

# Names of files and single-byte Western text.
FORBIDDEN_IN_NAMES = r"[<>:\"/\\|?*\x00-\x1f]"
WESTERN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
PDF_SUBSTITUTES = (("[\u2032\u2035]", "'"), ("[\u2033\u2036]", '"'), ("[\u2192\u27f6]", "->"), ("\u2212", "-"), ("[\u2009\u202f]", " "))

# Corpus building and signal checks.
CORPUS_GAP_SEC, CORPUS_OVERLAP_SEC, CORPUS_SNR_DB, CORPUS_SEED = 0.4, 0.25, 10.0, 20260823
ENERGY_RATIO = 4.0
BURSTS = ((1.0, 2.0), (3.0, 4.0), (5.0, 5.5))

# English contractions, in order of application.
CONTRACTIONS = (
    (r"(?<![A-Za-z0-9_])can't(?![A-Za-z0-9_])", "cannot"),
    (r"(?<![A-Za-z0-9_])won't(?![A-Za-z0-9_])", "will not"),
    (r"(?<![A-Za-z0-9_])shan't(?![A-Za-z0-9_])", "shall not"),
    (r"n't(?![A-Za-z0-9_])", " not"),
    (r"(?<![A-Za-z0-9_])i'm(?![A-Za-z0-9_])", "i am"),
    (r"(?<![A-Za-z0-9_])i've(?![A-Za-z0-9_])", "i have"),
    (r"(?<![A-Za-z0-9_])i'll(?![A-Za-z0-9_])", "i will"),
    (r"(?<![A-Za-z0-9_])i'd(?![A-Za-z0-9_])", "i would"),
    (r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)'re(?![A-Za-z0-9_])", "$1 are"),
    (r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)'ve(?![A-Za-z0-9_])", "$1 have"),
    (r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)'ll(?![A-Za-z0-9_])", "$1 will"),
    (r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)'d(?![A-Za-z0-9_])", "$1 would"),
    (r"(?<![A-Za-z0-9_])it's(?![A-Za-z0-9_])", "it is"),
    (r"(?<![A-Za-z0-9_])that's(?![A-Za-z0-9_])", "that is"),
    (r"(?<![A-Za-z0-9_])there's(?![A-Za-z0-9_])", "there is"),
    (r"(?<![A-Za-z0-9_])here's(?![A-Za-z0-9_])", "here is"),
    (r"(?<![A-Za-z0-9_])what's(?![A-Za-z0-9_])", "what is"),
    (r"(?<![A-Za-z0-9_])who's(?![A-Za-z0-9_])", "who is"),
    (r"(?<![A-Za-z0-9_])he's(?![A-Za-z0-9_])", "he is"),
    (r"(?<![A-Za-z0-9_])she's(?![A-Za-z0-9_])", "she is"),
    (r"(?<![A-Za-z0-9_])let's(?![A-Za-z0-9_])", "let us"),
)

# Number words, Spanish then English, without diacritics.
UNITS = {
    "cero": 0, "uno": 1, "una": 1, "un": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veinte": 20, "veintiuno": 21, "veintiun": 21, "veintiuna": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25,
    "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90,
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
HUNDREDS = {
    "cien": 100, "ciento": 100, "doscientos": 200, "doscientas": 200, "trescientos": 300, "trescientas": 300, "cuatrocientos": 400, "cuatrocientas": 400,
    "quinientos": 500, "quinientas": 500, "seiscientos": 600, "seiscientas": 600, "setecientos": 700, "setecientas": 700, "ochocientos": 800, "ochocientas": 800,
    "novecientos": 900, "novecientas": 900,
}
HUNDRED_WORDS = ("hundred",)
THOUSAND_WORDS = ("mil", "thousand")
JOINERS = ("y", "and")
