"""Fixed values of the feature definitions. They must equal the published ones for equal results."""

#: A word: letters, digits, underscore. Equal in Java, Python and RE2.
WORD = r"[\p{L}\p{N}_]+"
URL = r"https?://[^\s]+|www\.[^\s]+"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
PUNCTUATION = r"[.,!?;:…]"
#: Runs of one character; (?d) lets only \n end a line.
REPEATS = r"(?d)(.)\1{2,}"

# Shorteners, top-level domains, keywords (two of them mix scripts), function words.
SHORTENERS = ["bit.ly", "goo.gl", "t.co", "tinyurl.com", "ow.ly"]
SUSPICIOUS_TLDS = [".xyz", ".top", ".click", ".loan", ".download", ".stream"]
SPAM_KEYWORDS = [
    "заработ", "дохoд", "бизнес", "вакансия", "работа на дому", "млн руб", "кредит", "займ", "casino", "казино", "ставки", "букмекер", "выиграл", "лотерея", "похудe", "диета",
    "таблетки", "препарат", "подписывайтесь", "переходи по ссылке", "жми сюда", "скидка", "акция", "бесплатно", "халява", "вот тут", "вот здесь", "тут можно", "здесь можно",
]
FUNCTION_WORDS = ["и", "в", "на", "с", "к", "о", "по", "для", "от", "из", "у", "за", "под", "над", "при", "через", "между", "что", "который", "как", "когда", "где", "почему", "если", "то", "но", "а", "или", "же", "ли", "бы"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Least counts and windows.
ENTROPY_MIN_COMMENTS = 5  # hour entropy needs more
ACTIVITY_MIN_COMMENTS = 2
FIRST_WORD_MIN_COMMENTS = 5
MATTR_WINDOW = 50
