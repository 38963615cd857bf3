"""Operations of a training-data pipeline: extraction, language, duplicates, tokens, archives.

Each module holds one operator: functions from DataFrames to DataFrames with an interface of its
own. ``queries`` applies each to its whole table and ``oracles`` holds the SQL for those that SQL
can express.
"""
