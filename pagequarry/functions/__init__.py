"""Column expressions, and the Python helpers that run inside Arrow-batched UDFs.

The helpers travel to the workers by value, inside the function that uses them, so a session that
somebody else built (or a cluster without this package installed) can run them.
"""

from pyspark import cloudpickle

from pagequarry.functions import markup, similar, vectors

for _module in (markup, similar, vectors):
    cloudpickle.register_pickle_by_value(_module)
