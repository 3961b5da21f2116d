"""Code-graph analytics on Spark DataFrames.

Every operator takes and returns DataFrames.  Graph tables carry the keys
``repository_id`` and ``revision_id``; answer tables carry ``question_id``.  All
operators work for every repository, revision and question of a table at once.
"""

__version__ = "0.1.0"
