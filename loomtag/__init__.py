"""loomtag: a Spark-first engine for collections of XML and HTML documents.

Documents become one columnar *event relation*; every other operation is a
DataFrame transformation over that relation.
"""
