"""corpusloom — labelled-corpus preparation, sampling, co-occurrence graphs,
graph feature propagation, batch model scoring and classifier evaluation on
Spark DataFrames.

Every public function takes DataFrames/Columns and returns DataFrames/Columns;
nothing is collected to the driver.  Python runs only inside ``mapInPandas``
where a user-supplied model callable is invoked.
"""

__version__ = "0.1.0"
