"""Examples of messages that stand where content should be, by kind, and of headings, navigation and forms around them (frame): the labelled rows the classifier of problem 8 is fitted on."""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
dolor sit amet lorem
tempor magna aliqua sed
sample text
your text here
insert your content here
put your text here
text goes here
content goes here
content to be added
placeholder
placeholder text
dummy text
this is a sample paragraph
filler filler filler
some text some text
test test test
foo bar foo bar
blah blah
asdf asdf
asdf qwer asdf
xxx xxx xxx
xxxxxxxx
xxxx xxxx
aaaa aaaa aaaa
tbd tbd tbd
example text example text
type something here
write your copy here
hier steht Blindtext
Platzhalter Text
内容待补充内容待补充
此处填写内容
这里输入正文
请输入内容
请在这里输入文字
请填写正文
这里是文字
这里是内容
此处是占位内容
占位文字
示例内容示例内容
示例文字
测试测试
测试文字测试文字
测试内容
文本文本文本
内容内容内容
正文正文
文字文字
待编辑待编辑
正文待编辑
样例文本样例文本
填充文字填充文字
"""
ERROR_PAGE = """
404 Not Found
Error 404: page not found
The page you are looking for could not be found
This page is no longer available
The requested URL was not found on this server
403 Forbidden
Access denied
You do not have permission to view this page
401 Unauthorized
Please log in again
Your session expired, please sign in
500 Internal Server Error
Internal error
An unexpected error occurred
Something went wrong, please try again later
Oops, an error occurred
503 Service Unavailable
The service is temporarily unavailable
Down for maintenance, back in 20 minutes
This site is under maintenance
502 Bad Gateway
504 Gateway Timeout
The upstream server did not respond in time
The connection was closed by the server
Connection refused
Request timed out after 30 s
Could not connect to the database
Error establishing database connection
Database error, query failed
Too many requests, slow down
429 Too Many Requests
Your request was blocked by the firewall
Please verify that you are human
Request ID: 7f3a9c21
Reference number: 18f2a4
Error code 500
Status 404
Fatal error: Uncaught exception in index.php on line 20
Traceback (most recent call last)
Exception in thread main java.lang.RuntimeException
java.io.IOException
at org.example.web.Handler.service(Handler.java:42)
thrown in /var/www/html/index.php
Warning: undefined variable in view.php
Failed to load resource, click to retry
Loading failed, try again
Seite nicht gefunden
Interner Serverfehler
页面不存在
404 找不到页面
您访问的页面不存在
您查看的内容已被删除
该文章可能已删除或移动
找不到您要的资源
没有访问权限
您无权访问此页面
抱歉,您没有权限
请先登录
登录已过期,请重新登录
会话失效,请登录
服务器内部错误
服务器错误 500
内部错误
系统错误,请稍后重试
系统繁忙
出错了
抱歉,页面出错
服务暂时不可用
网站维护中
系统维护,预计 30 分钟后恢复
正在维护,请稍后访问
网关错误
网关超时 504
上游服务器无响应
源站无法访问
节点返回 502
连接失败
连接超时
请求超时
数据库错误
数据库连接失败
等待响应超过 30 秒
访问太频繁
请求过多,请稍后再试
请完成验证
请拖动滑块完成验证
请求被拦截
请求 ID 7f3a9c21
请求号 18f2a4
错误码 500
状态码 404
加载失败,请重试
图片加载失败
点击重新加载
"""
SCRIPT_NOTICE = """
Please enable JavaScript
JavaScript is disabled in your browser
JavaScript is required to view this page
You need to enable JavaScript to run this app
This site requires JavaScript
<noscript>Please turn on JavaScript</noscript>
<noscript>This page needs scripts</noscript>
Your browser does not support JavaScript
Your browser is not supported
Unsupported browser
Please upgrade your browser
Please use a newer browser to see this page
Update your browser to continue
Turn on scripts and reload the page
Scripts are blocked, allow them for this site
Enable scripting in your settings
Enable cookies and scripts to continue
Cookies must be enabled
If nothing happens, check that scripts are allowed
Works best with scripts turned on
Bitte aktivieren Sie JavaScript
Ihr Browser wird nicht unterstützt
请开启 JavaScript
请启用 JavaScript 后继续
您的浏览器禁用了 JavaScript
本页需要 JavaScript 支持
本站依赖脚本运行
需要开启脚本才能显示
请允许运行脚本
脚本被禁用,请在设置中开启
<noscript>请启用脚本</noscript>
<noscript>此组件依赖脚本</noscript>
您的浏览器版本过低
浏览器不支持此功能
请升级浏览器
请更换浏览器访问
请使用最新版浏览器
当前浏览器不兼容
请开启 Cookie
请启用脚本和 Cookie 后刷新
长时间没有反应请检查脚本是否被拦截
"""
FRAME = """
Home
Home / Courses
Home / Notes / Labs
Help
Contact
About us
Help Contact About
Back to top
Back to the previous page
Contact the administrator
Next page
Sitemap
Log in
Aim
Purpose
Procedure
Steps
Course:
Due on
Comments:
Room and bench
Week:
Dear student, your mark is
Attachment
Teacher:
首页
首页 | 课程
首页 | 论坛 | 帮助
返回首页
返回上一页
联系我们
联系管理员
下一页
教研组
一、目的
二、步骤
三、结果
课程:
主讲:
附件:
思考题:
实验地点:
批阅意见:
同学你好,你的成绩为
本周内容为,请在之前完成
"""
EXAMPLES = {"frame": FRAME, "filler": FILLER, "error_page": ERROR_PAGE, "script_notice": SCRIPT_NOTICE}


def examples(kind: str) -> list[str]:
    """The examples of one kind."""
    return [x for x in EXAMPLES[kind].split("\n") if x]
