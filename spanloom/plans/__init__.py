"""Named queries: functions of a session and a folder of tables, with their SQL where SQL can say the same."""
