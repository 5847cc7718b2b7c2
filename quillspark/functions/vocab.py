"""Constant dictionaries. All values here are fixed: results depend on them as they are."""

from __future__ import annotations

# --- fixed values: stop words ------------------------------------------------------------
STOPWORDS = (
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "로", "으로", "와", "과", "도", "만", "에게", "한", "하여", "하고", "하는", "있는", "그",
    "및", "또는", "등", "위", "위한", "따라", "대한", "관한", "있다", "없다", "된다", "한다", "것", "수", "바", "때", "경우",
)

# --- fixed values: words that mark legal terms ---------------------------------------------
TERM_HINTS = (
    "위법", "적법", "고의", "과실", "구성요건", "책임", "정당방위", "긴급피난", "상당", "필요", "영장", "압수", "수색", "증거", "공소", "기소", "무죄", "유죄", "양형",
    "재심", "항소", "상고", "체포", "구속", "자백", "진술", "피고인", "피의자", "교사", "방조", "미수", "기수", "정범", "공범", "공동정범", "간접정범", "처벌",
    "법정형", "전문법칙", "위법수집증거", "임의성", "전문진술", "임의수사", "강제수사", "압수수색", "사법경찰관", "수사준칙", "재수사", "재체포", "재구속", "위헌", "합헌",
    "기본권", "과잉금지", "최소침해", "법익균형", "평등권", "표현의자유", "신체의자유", "행복추구권", "직업선택", "헌법불합치", "한정위헌", "헌법재판소", "행정처분", "행정행위",
    "취소", "무효", "재량", "기속", "신뢰보호", "법치행정", "허가", "특허", "인가", "신고", "위원회", "국가경찰위원회", "자치경찰위원회", "정보공개", "징계", "소청심사",
    "심의위원회", "판단", "판시", "인정", "부정", "허용", "금지", "효력", "성립", "해당", "적용", "위반",
)

# --- fixed values: particles and endings that are stripped from words ------------------------
ENDINGS = (
    "으로서", "으로써", "이라고", "라고", "이라는", "라는", "에서", "으로", "에게", "에서의", "에서는", "에서도", "이라", "이며", "이고", "이다", "이나", "이든",
    "이라도", "은", "는", "이", "가", "을", "를", "의", "에", "도", "만", "와", "과", "로", "께", "께서", "한테", "하였다", "되었다", "되었으며", "하였으며",
    "되었고", "하였고", "한다", "했다", "되며", "하며", "하고", "되고", "하여", "되어", "하자", "하는", "되는", "있는", "없는", "있다", "없다", "였다", "다고",
    "는지", "은지", "였는지", "였다고", "하다고", "한다고", "된다고", "되다고", "하는지", "되는지", "있는지", "없는지", "다는", "하게", "되게",
)

# --- fixed values: patterns of statutes, case numbers, dates and courts ------------------------
LEGAL_PATTERNS = (
    r"제\s*\d+\s*조(?:\s*의\s*\d+)?(?:\s*제\s*\d+\s*항)?(?:\s*제\s*\d+\s*호)?",
    r"\d{2,4}\s*[가-힣]{1,3}\s*\d+",
    r"\d{4}\s*[.년]\s*\d{1,2}\s*[.월]\s*\d{1,2}\s*[.일]?",
    r"(대법원|헌법재판소|고등법원|지방법원|가정법원|행정법원|특허법원)",
)

# --- fixed values: noun endings that add to a keyphrase's score, and verb rests that lower it ----
LEGAL_SUFFIXES = (
    "죄", "조", "법", "권", "위", "형", "심", "소", "처분", "결정", "판결",
)
VERB_RESTS = (
    "하", "되", "하여", "되며", "하며",
)

# --- fixed values: hints of study domains, in order of priority ---------------------------------
DOMAIN_HINTS = {
    "police_committees": ("위원회", "국가경찰위원회", "자치경찰위원회", "정보공개위원회", "징계위원회", "소청심사위원회", "심의위원회"),
    "constitutional_law": ("헌법", "위헌", "합헌", "과잉금지원칙", "목적", "수단", "최소침해", "법익균형", "헌법재판소"),
    "criminal_procedure_evidence": ("형사소송법", "증거", "전문법칙", "자백", "압수", "수색", "영장", "증거능력", "위법수집증거", "유류물"),
    "criminal_procedure_investigation": ("수사", "체포", "구속", "재수사", "사법경찰관", "검사", "수사준칙", "재체포", "재구속"),
    "criminal_law": ("형법", "총론", "각론", "구성요건", "위법성", "책임", "죄형법정주의", "죄수", "고의", "과실"),
}
GENERAL_DOMAIN = "general_legal"

# --- fixed values: study advice by domain; {0} stands for the first key sentence, {1} for keywords --
STUDY_FOCUS = {
    "constitutional_law": (
        "위헌/합헌 결론을 먼저 암기하고, 판례 번호와 연결해서 복습",
        "위헌 사유를 목적·수단·최소침해·법익균형 순서로 분류",
        "핵심 문장 체크: {0}",
    ),
    "criminal_procedure_evidence": (
        "증거능력 인정/배제 기준을 OX로 반복 훈련",
        "영장 필요 여부와 예외 사유를 숫자·요건으로 분리 암기",
        "쟁점 키워드: {1}",
    ),
    "criminal_procedure_investigation": (
        "체포·구속·영장 관련 기한/절차 숫자를 우선 암기",
        "재수사 요청 가능 요건을 주체·시점·범위로 나눠 복습",
        "핵심 문장 체크: {0}",
    ),
    "criminal_law": (
        "유무죄 결론을 사실관계 포인트와 함께 연결 암기",
        "총론이면 학설별 결론 차이를 표로 정리해 반복",
        "쟁점 키워드: {1}",
    ),
    "police_committees": (
        "위원회별 인원 범위·구성 요건·기한 숫자를 OX로 반복",
        "한 글자/숫자 함정 지문을 중심으로 오답노트 축적",
        "핵심 키워드 묶음: {1}",
    ),
    GENERAL_DOMAIN: (
        "핵심 쟁점-결론-시험포인트 3단 구조로 요약 후 복습",
        "헷갈리는 판례는 유사판례 2~3개와 비교하여 차이 암기",
        "핵심 문장 체크: {0}",
    ),
}
NO_KEYWORDS, NO_SENTENCE = "핵심 키워드 재확인", "핵심 문장 재확인"

# --- fixed values: sentence endings at which shortened texts may stop ------------------------------
CUT_ENDINGS = ("다.", "다 ", "요.", "임.", "니다.", "였다.", "한다.", "된다.", "이다.")
SNIPPET_ENDINGS = ("다.", "다 ", "요.", "임.", "니다.")
TERMINALS = ("다.", "요.", "다", "음.", "임.", "…", "?", "!", ".")
NO_SUMMARY = "요약 정보 부족"

# --- fixed values: rules of grounded answers, in the order they are reported ---------------------------
GROUNDING_RULES = (
    "must_have_citation",
    "citation_must_exist_in_retrieval",
    "uncertainty_on_missing_evidence",
    "quote_must_match_snippet",
)
