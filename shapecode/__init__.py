"""shapecode: dictionary coding of sampled signals and anomaly scoring on Spark.

Every public function takes and returns DataFrames (or Column expressions);
nothing is collected to the driver.  See README.md for the module map.
"""

__version__ = "0.1.0"
