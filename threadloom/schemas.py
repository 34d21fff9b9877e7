"""Schemas of the data model."""

MESSAGE = "mailbox_account string, mailbox_folder string, direction string, counterpart string, subject string, `from` string, `to` string, cc string, date string, message_id string, text string, arrival_seq bigint"
CHUNK = "id string, thread_id string, source string, text string, subject string, client_email string, manager_emails array<string>, date_start string, date_end string, language string, low_signal boolean, word_count int, distilled string, extra map<string,string>"
FAQ = "number string, theme string, theme_label string, frequency string, languages string, question string, question_original string, answer string, variants string"
CHAT_EXPORT = "chats struct<list: array<struct<id: bigint, name: string, type: string, messages: array<struct<id: bigint, type: string, `from`: string, from_id: string, date: string, date_unixtime: string, text: string, media_type: string, photo: string, file_name: string, contact_information: string, reply_to_message_id: bigint>>>>>"
MANIFEST = "chunk_id string, file_path string, content_sha256 string"
USAGE = "timestamp string, telegram_id bigint, question string, answer string, rate int"
AB = "question string, answer string, exp_answer string"
DEALS = "results struct<deal_search: struct<body: struct<clients: array<struct<id: bigint, name: string, deals_for_event: array<struct<id: bigint, title: string, employee_id: bigint, status: string>>>>>>>"
CLIENTS = "result array<struct<id: bigint, name: string, created_at: string, updated_at: string, contacts: array<struct<type_id: int, value: string>>>>"
HOST = "timestamp string, load1 string, load5 string, load15 string, mem_used string, mem_total string, mem_pct string, disk_used string, disk_total string, disk_pct string, container string, status string, cpu_pct string, mem_mib string, container_mem_pct string"
HISTORY = "user_id bigint, question string, answer string, ts timestamp"
