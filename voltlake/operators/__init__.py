"""The analytical operators, one module per subject.

Every operator takes ``Tables`` (and a ``GlobalFilter`` where the subject is
filtered) and returns one lazy DataFrame; none of them starts a job.
"""
