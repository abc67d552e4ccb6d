"""Operators of a training-data pipeline.

Records. A *trace* is the text of one series: the lines of its data file or CSV rendering, `series_id` and `trace`.
Operators that work on texts take traces; those on chats, web pages and languages, for which the project has no
records, are general and say so."""
