"""Moderata: text-moderation data work as Spark jobs.

Everything is a ``DataFrame -> DataFrame`` function or a ``Column`` expression;
see the sub-packages ``sources``, ``functions``, ``operators``, ``plans`` and
``streaming``.
"""
