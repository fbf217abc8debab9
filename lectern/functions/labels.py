"""Words and marks that outputs share (fixed values)."""

UNKNOWN_SPEAKER = -1
SPEAKER, UNKNOWN = "講者", "未知"
TRANSCRIPT_TITLE = "## 會議逐字稿 — "
DIAGNOSTICS_TITLE = "## 講者辨識診斷"
MARKER_PREFIX = "(此段轉錄異常"
NOTE_OPEN, NOTE_CLOSE = "〔", "〕"
FOOTNOTE, ENDNOTE = "註", "附註"
IMAGE_ALT = "圖片"
RECORD, RECORDS_OF, COLUMN = "第 {} 筆", "(共 {} 筆)", "欄位 "
CHART_NOTE = ("此處有圖表", ":", ",資料來源 ", "、", ",Markdown 無法呈現圖形")
ENCODING_NOTE = "本檔案的文字編碼無法確定,內容可能有亂碼,請對照原始檔案確認"
ATTACHMENT = "附件"
ATTACHMENT_NOTES = {"cycle": "附件「{}」的內容與上層郵件相同(自我包含),已略過", "budget": "附件數量或總大小超過上限,其餘附件未處理", "other": "附件「{}」不是可轉換的格式,已原樣存放"}
#: Above the list of what was moved by hand, and an entry of it.
REASSIGNED_NOTE = "> ⚠️ **這份逐字稿人工改掛過**,所以下面的數字與排序是**機器分群當下**的結果,與內文已經對不上:"
REASSIGNED_ENTRY = ("> - ", "的 ", " 段已改掛給「", "」")
REASSIGNED_NOBODY = "這一群"
