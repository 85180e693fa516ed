"""plumbline: dataset profiling and corpus preparation as Spark jobs.

``sources`` reads and writes, ``functions`` holds Column expressions, ``operators`` the
table operators, ``plans`` the assembled profiles, ``streaming`` the running profile.
"""
