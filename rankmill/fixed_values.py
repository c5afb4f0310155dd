"""Values the results must reproduce exactly: code lists, labels, thresholds and text patterns."""

# Server number -> server name. An unknown number reads as the first server.
SERVER_NAMES = {
    1: "데이안",
    2: "아이라",
    3: "던컨",
    4: "알리사",
    5: "메이븐",
    6: "라사",
    7: "칼릭스",
}

# Rank type number (div) -> rank type name, and the label of any other number.
RANK_TYPE_NAMES = {1: "전투력", 2: "매력", 3: "생활력"}
OTHER_RANK_TYPE_PREFIX = "타입"
RANK_TYPES = tuple(RANK_TYPE_NAMES)

# Class name -> (category, colour), and the colour of any other class.
CLASS_COLOURS = {
    "화염술사": ("magic", "#4285F4"),
    "빙결술사": ("magic", "#5E97F6"),
    "마법사": ("magic", "#7BAAF7"),
    "견습 마법사": ("magic", "#A8C7FA"),
    "석궁사수": ("archer", "#34A853"),
    "장궁병": ("archer", "#57BB8A"),
    "궁수": ("archer", "#7DCFA9"),
    "견습 궁수": ("archer", "#A9E2C9"),
    "검술사": ("melee", "#EA4335"),
    "듀얼블레이드": ("melee", "#EB6859"),
    "대검전사": ("melee", "#F08E85"),
    "전사": ("melee", "#F5B5B0"),
    "견습 전사": ("melee", "#FAD7D4"),
    "수도사": ("healer", "#FBBC05"),
    "힐러": ("healer", "#FCD259"),
    "사제": ("healer", "#FFE297"),
    "견습 힐러": ("healer", "#FFF0CE"),
    "도적": ("other", "#9575CD"),
    "격투가": ("other", "#B39DDB"),
    "악사": ("other", "#A1887F"),
    "댄서": ("other", "#90A4AE"),
    "음유시인": ("other", "#78909C"),
    "견습 음유시인": ("other", "#AEBEC7"),
    "견습 도적": ("other", "#C5CAE9"),
}
DEFAULT_CLASS_COLOUR = ("none", "#607D8B")

# Request states.
STATUSES = ("pending", "processing", "completed", "failed", "timeout")
OPEN_STATUSES = ("pending", "processing")
CLOSED_STATUSES = ("completed", "failed", "timeout")
TIMEOUT_MESSAGE = "Processing timeout"

# Worker state -> symbol, and the symbol of any other state.
STATUS_SYMBOLS = {
    "running": "🟢",
    "processing": "🔄",
    "waiting": "🟡",
    "stopped": "🔴",
    "error": "❌",
}
UNKNOWN_STATUS_SYMBOL = "❓"

# Labels and suffixes.
ALL_LABEL = "all"
PLACEHOLDER_NAME = "알수없음"
RANK_SUFFIX = "위"
PERSON_SUFFIX = " 명"
NO_TIME_LABEL = "없음"
SECONDS_AGO = "초 전"
MINUTES_AGO = "분 전"
HOURS_AGO = "시간 전"
IDLE_LABEL = "대기중"
ZONE_LABEL = " KST"
LOCAL_ZONE = "Asia/Seoul"
LOCAL_OFFSET = "+09:00"
DEFAULT_FRONTIER_NAME = "힝트"

# Answer messages.
STATUS_MESSAGES = {
    "failed": "검색이 실패했습니다.",
    "processing": "검색이 처리 중입니다.",
    "pending": "검색이 대기 중입니다.",
}
OTHER_STATUS_MESSAGE_PREFIX = "검색 상태: "
FOUND_MESSAGE = "Character found in rankings"
# server and name go into the places marked by braces
NAME_NOT_FOUND_MESSAGE = "캐릭터 '{name}'을(를) 서버 '{server}'에서 찾을 수 없습니다."
CACHE_MESSAGE = "Retrieved from cache (less than 10 minutes old)"

# Phrases that identify page kinds.
NOT_FOUND_PHRASES = ("입력한 캐릭터명의", "랭킹 정보를 찾을 수 없습니다")
CHALLENGE_TITLES = ("잠시만 기다리십시오", "Just a moment")

# Thresholds.
FRESH_SECONDS = 600
MIN_FRESH_ROWS = 20
OUTDATED_LIMIT = 100
ROWS_PER_PAGE = 20
DEDUP_SECONDS = 300
PROCESSING_SECONDS = 600
HOURLY_TTL_SECONDS = 3600
