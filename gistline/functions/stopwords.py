"""Common function words, left out by the tokenisers. A parameter everywhere."""

ENGLISH = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off "
    "on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves also among may might must shall upon via".split()
)
CHINESE = tuple("我们 你们 他们 她们 它们 这个 那个 这些 那些 什么 怎么 因为 所以 但是 而且 如果 或者 以及 可以 没有 一个 一些 已经 自己 还是 就是 不是 这样 那样".split())
