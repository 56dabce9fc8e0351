"""Pattern analytics over baskets, sequences and pair graphs, on Spark DataFrames.

The layers, bottom up:

``functions``  column helpers, shared-folder tables, exact range counting
``sources``    readers, the result table, bindings of star-schema tables to baskets
``operators``  DataFrame-to-DataFrame operators (mining, graphs, clustering, layout)
``plans``      compositions: batch mining, served charts, the ordering sweep, the query catalogue
"""
