"""Schemas and fixed values of the span model. Spans are half-open, in UTF-16 code units."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that results must agree on: types, default policies, labels, kinds, codes, limits.
PII_TYPES = ["PERSON", "RRN", "FRN", "CARD_NUMBER", "ACCOUNT_NUMBER", "SECRET", "USER_ID", "EMAIL", "PHONE", "PASSPORT", "DRIVER_LICENSE", "GENERIC_ID", "ADDRESS", "ZIPCODE", "DATE", "CARD_EXPIRY", "CVC", "IPIN"]
AUTO_MASKED = ["RRN", "FRN", "CARD_NUMBER", "ACCOUNT_NUMBER", "SECRET", "PASSPORT", "DRIVER_LICENSE", "CVC", "IPIN", "PHONE", "EMAIL"]
AUTO, CONFIRM = "AUTO_MASK", "CONFIRM"
LABELS = {"PERSON": "이름", "RRN": "주민등록번호", "FRN": "외국인등록번호", "CARD_NUMBER": "카드번호", "ACCOUNT_NUMBER": "계좌번호", "SECRET": "비밀번호 · 키", "USER_ID": "사용자 ID", "EMAIL": "이메일", "PHONE": "전화번호", "PASSPORT": "여권번호", "DRIVER_LICENSE": "운전면허번호", "GENERIC_ID": "기타 식별번호", "ADDRESS": "주소", "ZIPCODE": "우편번호", "DATE": "날짜 · 시간", "CARD_EXPIRY": "카드 유효기간", "CVC": "카드 CVC", "IPIN": "아이핀"}
KIND_BY_EXTENSION = {"pdf": "pdf", "docx": "docx", "doc": "docx", "hwpx": "hwpx", "hwp": "hwpx", "txt": "text", "md": "text", "csv": "text", "tsv": "text", "json": "text", "log": "text", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "gif": "image", "bmp": "image", "svg": "image"}
TEXT_MIME = {"txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown"}
ERROR_RULES = [
    ("PDF_OCR_REQUIRED", "requires OCR|unsupported text layout"),
    ("DOCUMENT_LIMIT", "limit exceeded|unsupported PDF page count|unsupported PDF page dimensions|invalid PDF limits"),
    ("DOCUMENT_FORMAT", "encrypted|password|invalid PDF input|^DOCX:"),
    ("DOCUMENT_SESSION", "session unavailable|session not ready|session closed"),
    ("DOCUMENT_WORKER", "worker|content security policy|failed to fetch|document host unavailable|receiving end does not exist"),
]
ERROR_DEFAULT = "DOCUMENT_FAILED"
NOTICES = {
    "PDF_OCR_REQUIRED": "이 PDF는 이미지 또는 스캔 페이지가 포함되어 있어 현재 검사할 수 없습니다. 텍스트 PDF 또는 DOCX로 다시 시도해 주세요.",
    "DOCUMENT_LIMIT": "문서 크기 또는 페이지 수가 처리 한도를 초과했습니다. 파일을 나눠서 다시 시도해 주세요.",
    "DOCUMENT_FORMAT": "암호가 설정됐거나 지원하지 않는 문서 형식입니다. 암호 없는 PDF 또는 DOCX로 다시 시도해 주세요.",
    "DOCUMENT_WORKER": "문서 처리 모듈을 실행하지 못했습니다. 확장 프로그램과 ChatGPT 탭을 새로고침해 주세요.",
    "DOCUMENT_SESSION": "문서 처리 연결이 만료됐습니다. 파일을 다시 첨부해 주세요.",
    "DOCUMENT_FAILED": "문서 처리에 실패했습니다. Console의 오류 코드와 처리 단계를 확인해 주세요.",
    "MODEL": "개인정보 검사 모델을 준비하거나 실행하지 못했습니다. 네트워크 연결을 확인하고 다시 시도해 주세요.",
}
OUT_OF_MEMORY = "out of memory|allocation failed|memory access out of bounds"
BLOCK, BULLET = "█", "•"
TEXT_LIMITS = {"input_bytes": 10 << 20, "output_bytes": 12 << 20, "characters": 5_000_000}
PACKAGE_LIMITS = {"input_bytes": 25 << 20, "output_bytes": 50 << 20, "expanded_bytes": 100 << 20, "entries": 2048, "paragraphs": 10_000, "characters": 1_000_000, "depth": 128}
PDF_LIMITS = {"input_bytes": 25 << 20, "output_bytes": 50 << 20, "pages": 100, "characters": 1_000_000, "pixels": 16_000_000, "scale": 2}
CHUNK_TOKENS, CHUNK_OVERLAP, MAX_TOKENS, VOCABULARY = 512, 128, 2048, 50_000
TRANSPORT_BYTES = 512 << 10

SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)])
CONSTITUENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType()), *SPAN.fields])
SEGMENTS = "doc_id long, ord int, segment_id string, text string"
DETECTIONS = "doc_id long, segment_id string, ord int, type string, confidence double, start int, stop int"
TOKEN = "struct<id:int,start:int,stop:int,attn:int,special:int>"
REJECTS = "doc_id string, stage string, code string"


def default_policy(kind: str) -> str:
    return AUTO if kind in AUTO_MASKED else CONFIRM
